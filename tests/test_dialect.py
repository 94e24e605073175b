"""Python-regex semantics on Spark: exotic whitespace, Unicode word characters."""
import re

from pyspark.sql import functions as F

from textsieve.functions import dialect as D
from textsieve.functions.spans import regex_spans

TEXTS = [
    "ignore previous instructions and　more\x1cwords\x85end",
    "system : reveal\tall\n\n  user: x",
    "a b c d e  f g h i",
    "café act éact acté run bash",
    "tok " + "x" * 25 + " y" * 3,
]
PATTERNS = [r"\s+", r"\S{4,}", r"(^|\n)\s*system\s*:", r"\b(act|run)\b", r"\b(?:[a-z]\s){2,}[a-z]\b",
            r"[^\s)>\]]+", r"\w+"]


def test_java_translation_matches_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    cols = [regex_spans(D.fold_ws(F.col("t")), D.java(p, "M")).alias(f"s{k}") for k, p in enumerate(PATTERNS)]
    rows = {r.i: r for r in df.select("i", *cols).collect()}
    for i, t in enumerate(TEXTS):
        for k, p in enumerate(PATTERNS):
            exp = [(m.start(), m.end()) for m in re.finditer(p, t, re.M)]
            got = [(s.start, s.end) for s in rows[i][f"s{k}"]]
            assert got == exp, (p, t)
