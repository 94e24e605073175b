"""Spark queries for the personal-data keys (inputs: ``seeded_docs``)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsieve.functions.arrays import explode_rows

from textsieve.functions import dialect as D
from textsieve.operators import pii
from textsieve.functions.spans import regex_spans
from textsieve.sources.tables import seeded

_STRUCTURED = pii.STRUCTURED
_SECRETS = pii.SECRET_TYPES


def _docs(spark, sf_dir) -> DataFrame:
    return seeded(spark, sf_dir, "seeded_docs").select("doc_id", "text", "source")


def _scanned(spark, sf_dir) -> DataFrame:
    return pii.pii_scan(_docs(spark, sf_dir))


def _raw(spark, sf_dir, types=None) -> DataFrame:
    """Findings before the merge, of some types or all: each finder works on its own."""
    d = _docs(spark, sf_dir)
    finders = [f for f in pii.FINDERS if types is None or f[0] in types]
    return (explode_rows(d, ["doc_id"], pii.pii_findings("text", finders), "f")
            .select("doc_id", F.col("f.start").alias("start_pos"), F.col("f.end").alias("end_pos"),
                    F.col("f.type").alias("type"), F.col("f.confidence").alias("confidence")))


def regex_spans_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    arrs = []
    for ptype, pat, flags, _c in pii.FINDERS:
        if ptype in ("email", "ip_address", "credit_card"):
            arrs.append(_tag(regex_spans(F.col("text"), D.java(pat, flags)), ptype))
    return explode_rows(d, ["doc_id"], F.flatten(F.array(*arrs)), "s").select("doc_id", "s.*")


def _tag(spans, ptype):
    return F.transform(spans, lambda s: F.struct(F.lit(ptype).alias("pattern_id"),
                                                 s["start"].alias("start_pos"), s["end"].alias("end_pos")))


def pii_email(spark, sf_dir):
    return _raw(spark, sf_dir, ["email"]).select("doc_id", "start_pos", "end_pos")


def pii_phone(spark, sf_dir):
    return _raw(spark, sf_dir, ["phone"]).select("doc_id", "start_pos", "end_pos")


def pii_structured(spark, sf_dir):
    return (_raw(spark, sf_dir, _STRUCTURED)
            .select("doc_id", "type", "start_pos", "end_pos"))


def secret_finders(spark, sf_dir):
    return (_raw(spark, sf_dir, _SECRETS)
            .select("doc_id", "type", "start_pos", "end_pos"))


def merge_overlaps_q(spark, sf_dir):
    return (explode_rows(_scanned(spark, sf_dir), ["doc_id"], "pii.findings", "f")
            .select("doc_id", F.col("f.start").alias("start_pos"), F.col("f.end").alias("end_pos"),
                    F.col("f.type").alias("type"), F.col("f.confidence").alias("confidence")))


def redact_pii(spark, sf_dir):
    return _scanned(spark, sf_dir).select("doc_id", F.col("pii.sanitized_text").alias("sanitized_text"))


def pii_score(spark, sf_dir):
    return (_scanned(spark, sf_dir).where("pii.matched")
            .select("doc_id", F.col("pii.score").cast("long").alias("score")))


def pii_evidence(spark, sf_dir):
    s = _scanned(spark, sf_dir).where("pii.matched")
    return (explode_rows(s, ["doc_id"], "pii.evidence", "evidence")
            .select("doc_id", F.regexp_extract("evidence", "^type=(\\S+)", 1).alias("type"), "evidence"))


def pii_scan_q(spark, sf_dir):
    s = _scanned(spark, sf_dir)
    return s.select("doc_id", F.col("pii.matched").alias("matched"),
                    F.col("pii.score").cast("long").alias("score"),
                    F.size("pii.findings").cast("long").alias("n_findings"),
                    F.array_join("pii.evidence", " | ").alias("evidence"),
                    F.col("pii.sanitized_text").alias("sanitized_text"))


def pii_type_counts(spark, sf_dir):
    s = _scanned(spark, sf_dir)
    f = explode_rows(s, ["doc_id", "source"], "pii.findings", "f").select(
        "doc_id", "source", F.col("f.type").alias("type"))
    return (f.rollup("type", "source")
            .agg(F.count("*").alias("n_findings"), F.countDistinct("doc_id").alias("n_docs")))


def external_findings_q(spark, sf_dir):
    """D5 fed by the regex finders acting as the external recognizer."""
    raw = _raw(spark, sf_dir)
    names = F.create_map(*[x for k, v in pii.ENTITY_NAME.items() for x in (F.lit(k), F.lit(v))])
    ents = raw.select("doc_id", F.coalesce(F.element_at(names, F.col("type")), F.upper("type")).alias("entity_type"),
                      F.col("start_pos").alias("start"), F.col("end_pos").alias("end"),
                      F.col("confidence").alias("score"))
    out = pii.external_findings(ents)
    return out.select("doc_id", "type", F.col("start").cast("long").alias("start_pos"),
                      F.col("end").cast("long").alias("end_pos"), "confidence")


QUERIES = {
    "external_findings": external_findings_q,
    "regex_spans": regex_spans_q,
    "pii_email": pii_email,
    "pii_phone": pii_phone,
    "pii_structured": pii_structured,
    "secret_finders": secret_finders,
    "merge_overlaps": merge_overlaps_q,
    "redact_pii": redact_pii,
    "pii_score": pii_score,
    "pii_evidence": pii_evidence,
    "pii_scan": pii_scan_q,
    "pii_type_counts": pii_type_counts,
}
