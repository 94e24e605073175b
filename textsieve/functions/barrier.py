"""Keeping the optimizer from copying a large expression into what is built on it."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def computed_once(value: Column) -> Column:
    """``value``, computed where it is defined.

    A filter, aggregate or projection over a derived column is normally merged
    into the projection that defines it, which copies the expression for every
    use; for detector results (hundreds of regexes) the plan then explodes.
    Expressions marked non-deterministic are neither copied nor pushed, so the
    value hangs under a condition that always holds but that the optimizer must
    not fold.  The value itself stays deterministic."""
    return F.when(F.spark_partition_id() >= 0, value)
