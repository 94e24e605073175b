"""Span primitives as native Spark column expressions (no UDF).

``regex_spans`` returns every non-overlapping match of a regex as 0-based,
end-exclusive ``(start, end)`` code-point offsets, exactly like Python's
``finditer``: ``split(text, p, -1)`` yields the gaps and
``regexp_extract_all(text, p, 0)`` the matches, both found by the same
left-to-right ``Matcher.find`` loop, so running lengths give the offsets.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN_TYPE = "array<struct<start:int,end:int>>"


def regex_spans(text: Column, java_pattern: str) -> Column:
    pieces = F.split(text, java_pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(java_pattern), 0)
    lens = F.zip_with(pieces, matches,
                      lambda p, m: F.struct(F.length(p).alias("lp"), F.length(m).alias("lm")))
    init = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN_TYPE).alias("spans"))

    def step(acc, x):
        s = acc["pos"] + x["lp"]
        e = s + x["lm"]
        return F.when(x["lm"].isNull(), acc).otherwise(
            F.struct(e.alias("pos"),
                     F.concat(acc["spans"], F.array(F.struct(s.alias("start"), e.alias("end"))))
                     .alias("spans")))

    return F.aggregate(lens, init, step, lambda acc: acc["spans"])


def guarded_spans(text: Column, java_pattern: str, prefilter: Column | None = None) -> Column:
    """``regex_spans`` only on rows that can match (one cheap pass first)."""
    cond = text.rlike(java_pattern) if prefilter is None else (prefilter & text.rlike(java_pattern))
    return F.when(cond, regex_spans(text, java_pattern)).otherwise(F.array().cast(SPAN_TYPE))


def label_spans(spans: Column, **fields: Column) -> Column:
    """Attach constant/derived fields to every span struct."""
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        *[v.alias(k) for k, v in fields.items()]))


def oracle_spans_sql(text_sql: str, re2_pattern: str) -> str:
    """DuckDB list expression: list of {start, end} for every match."""
    p = "'" + re2_pattern.replace("'", "''") + "'"
    pcs = f"regexp_split_to_array({text_sql}, {p})"
    ms = f"regexp_extract_all({text_sql}, {p})"
    return (
        f"(SELECT list_transform(range(1, len(ms) + 1), lambda i: "
        f"{{'start': CAST(list_sum(list_transform(pcs[1:i], lambda x: length(x))) + "
        f"coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS INTEGER), "
        f"'end': CAST(list_sum(list_transform(pcs[1:i], lambda x: length(x))) + "
        f"list_sum(list_transform(ms[1:i], lambda x: length(x))) AS INTEGER)}}) "
        f"FROM (SELECT {pcs} AS pcs, {ms} AS ms))"
    )


def sql_literal(s: str) -> str:
    """Spark SQL string literal for an arbitrary string (regex patterns)."""
    if "'" not in s:
        return "r'" + s + "'"
    if '"' not in s:
        return 'r"' + s + '"'
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def regex_spans_sql(text_sql: str, java_pattern: str) -> str:
    """Spark SQL text of :func:`regex_spans` (built as one string: one parse
    instead of many driver round trips when hundreds of patterns are used)."""
    return pattern_spans_sql(text_sql, sql_literal(java_pattern))


def pattern_spans_sql(text_sql: str, pattern_sql: str) -> str:
    """The same with the pattern itself as SQL, so that one expression serves a whole table of patterns."""
    return (f"aggregate(zip_with(split({text_sql}, {pattern_sql}, -1), regexp_extract_all({text_sql}, {pattern_sql}, 0), "
            f"(p, m) -> named_struct('lp', length(p), 'lm', length(m))), "
            f"named_struct('pos', 0, 'spans', CAST(array() AS {SPAN_TYPE})), "
            f"(acc, x) -> CASE WHEN x.lm IS NULL THEN acc ELSE named_struct('pos', acc.pos + x.lp + x.lm, "
            f"'spans', concat(acc.spans, array(named_struct('start', acc.pos + x.lp, 'end', acc.pos + x.lp + x.lm)))) END, "
            f"acc -> acc.spans)")
