"""Merge overlapping spans and redact them, per row, as array expressions.

Both run inside the row that owns the text (no shuffle, no join back):
``merge_overlaps`` folds spans sorted by ``(start, ord)``; a span overlaps the
open island when ``start < island end``; the island keeps the union and the
label of its highest rank, earliest on ties.  ``redact`` cuts the original text
at the merged spans and joins the gaps with one token per span.
"""
from __future__ import annotations

from typing import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge_overlaps(spans: Column, struct_ddl: str, rank: str,
                   or_fields: Iterable[str] = ()) -> Column:
    """spans: array<struct<start:int, ord:int, end:int, ...>>; struct_ddl: its element type."""
    or_fields = list(or_fields)
    ordered = F.array_sort(spans)          # struct order: start, then ord
    elem_fields = [f.split(":")[0].strip() for f in _split_fields(struct_ddl)]
    null_elem = F.lit(None).cast(struct_ddl)
    init = F.struct(F.array().cast(f"array<{struct_ddl}>").alias("done"), null_elem.alias("cur"))

    def union(cur, f):
        win = F.when(cur[rank] >= f[rank], cur).otherwise(f)
        cols = []
        for name in elem_fields:
            if name == "start":
                cols.append(F.least(cur["start"], f["start"]).alias("start"))
            elif name == "end":
                cols.append(F.greatest(cur["end"], f["end"]).alias("end"))
            elif name == "ord":
                cols.append(cur["ord"].alias("ord"))
            elif name in or_fields:
                cols.append((cur[name] | f[name]).alias(name))
            else:
                cols.append(win[name].alias(name))
        return F.struct(*cols)

    def step(acc, f):
        cur = acc["cur"]
        return (F.when(cur.isNull(), F.struct(acc["done"].alias("done"), f.alias("cur")))
                .when(f["start"] < cur["end"],
                      F.struct(acc["done"].alias("done"), union(cur, f).alias("cur")))
                .otherwise(F.struct(F.concat(acc["done"], F.array(cur)).alias("done"),
                                    f.alias("cur"))))

    def finish(acc):
        return F.when(acc["cur"].isNull(), acc["done"]).otherwise(
            F.concat(acc["done"], F.array(acc["cur"])))

    return F.aggregate(ordered, init, step, finish)


def _split_fields(struct_ddl: str):
    inner = struct_ddl.strip()[len("struct<"):-1]
    depth, cur, out = 0, "", []
    for ch in inner:
        if ch == "<":
            depth += 1
        elif ch == ">":
            depth -= 1
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    if cur:
        out.append(cur)
    return out


def redact(text: Column, merged: Column, token: Callable[[Column], Column]) -> Column:
    """One pass over the original text; ``merged`` is sorted and non-overlapping."""
    prev_end = F.concat(F.array(F.lit(0)), F.transform(merged, lambda m: m["end"]))
    pieces = F.zip_with(merged, prev_end, lambda m, pe: F.concat(
        text.substr(pe + 1, m["start"] - pe), token(m)))
    tail_from = F.element_at(prev_end, -1)
    return F.concat(F.array_join(pieces, ""), text.substr(tail_from + 1, F.length(text) + 1))


def span_list_repr(spans: Column) -> Column:
    """Python repr of a list of (start, end) tuples: ``[(1, 5), (9, 12)]``."""
    return F.concat(F.lit("["), F.array_join(F.transform(spans, lambda s: F.concat(
        F.lit("("), s["start"].cast("string"), F.lit(", "), s["end"].cast("string"), F.lit(")"))),
        ", "), F.lit("]"))
