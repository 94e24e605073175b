"""Native span extraction equals Python's finditer on every document."""
import re

from pyspark.sql import functions as F

from paths import SF001
from textsieve.functions import dialect as D
from textsieve.functions.spans import regex_spans
from textsieve.functions import patterns as P
from textsieve.sources.tables import read_table

PATTERNS = [(P.EMAIL, "I"), (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", ""), (r"={3,}|-{3,}|#{3,}", "M"),
            (r"[A-Za-z0-9+/]{40,}={0,2}", ""), (r"\S{20,}", ""), (r"(?<=[.!?])\s+|\n+", "")]


def test_regex_spans_match_finditer(spark):
    docs = read_table(spark, SF001, "documents").select("doc_id", "text")
    cols = [regex_spans(D.fold_ws(F.col("text")), D.java(p, f)).alias(f"s{i}") for i, (p, f) in enumerate(PATTERNS)]
    rows = docs.select("text", *cols).collect()
    assert rows
    for r in rows:
        for i, (p, f) in enumerate(PATTERNS):
            flags = (re.I if "I" in f else 0) | (re.M if "M" in f else 0)
            exp = [(m.start(), m.end()) for m in re.finditer(p, r.text, flags)]
            got = [(s.start, s.end) for s in r[f"s{i}"]]
            assert got == exp, (p, r.text[:80])
