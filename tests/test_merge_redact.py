"""Merge/redact invariants on real documents and random spans."""
import random
import re

from pyspark.sql import functions as F

from paths import SF01
from textsieve.functions.merge import merge_overlaps, redact
from textsieve.functions import patterns as P
from textsieve.operators import pii
from textsieve.sources.tables import seeded

DDL = "struct<start:int,ord:int,end:int,type:string,confidence:double>"


def test_merge_is_the_union_of_intervals(spark):
    """Merged spans cover the same positions, do not overlap, and carry the best confidence of what they hold."""
    rnd = random.Random(7)
    rows = []
    for k in range(300):
        fs = []
        for o in range(rnd.randint(0, 12)):
            s = rnd.randint(0, 60)
            fs.append((s, o, s + rnd.randint(1, 15), rnd.choice("abc"), rnd.choice([0.5, 0.9, 0.95])))
        rows.append((k, fs))
    df = spark.createDataFrame(rows, f"k int, fs array<{DDL}>")
    got = {r.k: r.m for r in df.select("k", merge_overlaps(F.col("fs"), DDL, "confidence").alias("m")).collect()}
    for k, fs in rows:
        held = [[f for f in fs if m.start <= f[0] and f[2] <= m.end] for m in got[k]]
        assert sorted(f for h in held for f in h) == sorted(fs)                       # each finding in one span
        assert {p for f in fs for p in range(f[0], f[2])} == {p for m in got[k] for p in range(m.start, m.end)}
        for m, h in zip(got[k], held):
            best = max(f[4] for f in h)
            assert m.confidence == best
            assert m.type == min((f for f in h if f[4] == best), key=lambda f: (f[0], f[1]))[3]


def test_redacted_documents_keep_no_email(spark):
    docs = seeded(spark, SF01, "seeded_docs").select("doc_id", "text")
    out = pii.pii_scan(docs).select("text", "pii.sanitized_text", "pii.findings").collect()
    email = re.compile(P.EMAIL, re.I)
    n = 0
    for r in out:
        assert not email.search(r.sanitized_text)
        for a, b in zip(r.findings, r.findings[1:]):
            assert a.end <= b.start                      # merged spans never overlap
        n += len(r.findings)
    assert n > 0


def test_redaction_is_idempotent(spark):
    docs = seeded(spark, SF01, "seeded_docs").select("doc_id", "text")
    # cut the lineage between the two scans (reliable checkpoint in spark.checkpoint.dir)
    once = pii.pii_scan(docs).select("doc_id", F.col("pii.sanitized_text").alias("text")).checkpoint()
    twice = pii.pii_scan(once).select("doc_id", "text", F.col("pii.sanitized_text").alias("again"))
    assert twice.where("text <> again").count() == 0


def test_redact_one_pass(spark):
    df = spark.createDataFrame([("abcdefghij", [(1, 0, 3, "x", 1.0), (5, 1, 8, "y", 1.0)])],
                               f"t string, m array<{DDL}>")
    r = df.select(redact(F.col("t"), F.col("m"), lambda f: F.concat(F.lit("<"), f["type"], F.lit(">")))).first()[0]
    assert r == "a<x>de<y>ij"
