"""Array helpers."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` evaluated once: expressions around lambdas are interpreted, and an expression that is
    used several times there is evaluated each time."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def explode_rows(df: DataFrame, keep, arr: Column, alias: str = "f", pos: str | None = None) -> DataFrame:
    """One row per element of a computed array (rows with empty arrays vanish).

    Uses ``explode_outer`` and filters above the generator: a plain ``explode``
    makes the optimizer infer ``size(arr) > 0`` and push that predicate below
    the projections, where the whole array expression is re-inlined and
    evaluated again for every row."""
    keep = list(keep)
    if pos:
        out = df.select(*keep, F.posexplode_outer(arr).alias(pos, alias))
    else:
        out = df.select(*keep, F.explode_outer(arr).alias(alias))
    return out.where(F.col(alias).isNotNull())
