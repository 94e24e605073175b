"""Connected components of a distributed link table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsieve.llm.common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; component is its smallest node.

    Alternates two star steps until nothing changes.  The large step hangs a node's
    larger neighbours, the small step its smaller ones, on the smallest neighbour.
    Both keep components and never grow the table, and rounds grow with the
    logarithm of the nodes.  A step is one aggregation and one join on the node; a
    hub's rows are only joined, never gathered, and adaptive execution splits them.
    Self links and nulls are ignored.
    """
    pairs = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                .where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND u > v").distinct())       # u hangs on v
    while True:
        # large step: every neighbour above u goes to the smallest neighbour of u (or u)
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # small step: u and its smaller neighbours go to the smallest of these
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(lowest, "u")
        small = cut(hung.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                    .unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        changed = small.exceptAll(pairs).limit(1).count()
        pairs = small
        if not changed:
            break
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return (pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
            .unionByName(roots.join(pairs.select(F.col("u").alias("node")), "node", "left_anti")
                         .select("node", F.col("node").alias("component"))))


def component_ids(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(row, component_id) for the rows of (row, id) that ``links`` (a, b: rows) connect to others, or that
    share their id with another row; component_id is the smallest id of the component."""
    named = rows.select("row", "id").where("id IS NOT NULL")
    repeated = named.groupBy("id").agg(F.min("row").alias("first"), F.max("row").alias("last")).where("first < last")
    same = named.join(repeated, "id").select(F.col("row").alias("a"), F.col("first").alias("b"))
    found = cut(components(links.select("a", "b").unionByName(same).where("a <> b")))
    least = (found.join(named, found["node"] == named["row"]).groupBy("component")
             .agg(F.min("id").alias("component_id")))
    return found.join(least, "component").select(F.col("node").alias("row"), "component_id")
