"""Spark queries for the document-injection keys (inputs: ``seeded_docs``)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsieve.functions.arrays import explode_rows

from textsieve.functions import dialect as D
from textsieve.functions.barrier import computed_once
from textsieve.operators import rag as RAG
from textsieve.operators import similarity as SIM
from textsieve.sources.tables import read_table, seeded


def _docs(spark, sf_dir) -> DataFrame:
    return seeded(spark, sf_dir, "seeded_docs").select("doc_id", "document_id", "text", "source")


def _folded(spark, sf_dir) -> DataFrame:
    """Documents with their folded text as a column: as an expression it would be folded again for every use."""
    return _docs(spark, sf_dir).withColumn("_fraw", computed_once(D.fold_ws(F.col("text"))))


def _views(spark, sf_dir) -> DataFrame:
    return RAG.add_doc_views(_docs(spark, sf_dir), "text")


def _probed(spark, sf_dir) -> DataFrame:
    """Documents with their views and what the rules' tests find in them."""
    return RAG.add_probes(RAG.add_doc_views(_docs(spark, sf_dir), "text", folded="_fraw"))


def _spans_of(df: DataFrame, arr, with_id=True) -> DataFrame:
    s = explode_rows(df, ["doc_id"], arr, "f")
    cols = ["doc_id"] + ([F.col("f.signature_id").alias("signature_id")] if with_id else []) + [
        F.col("f.start").cast("long").alias("start_pos"), F.col("f.end").cast("long").alias("end_pos")]
    return s.select(*cols)


def _cols(v):
    return F.col("_dnorm"), F.col("_dleet"), F.col("_dmap"), F.col("_ddels"), F.length("text")


def normalize_with_map(spark, sf_dir):
    v = _views(spark, sf_dir)
    return v.select("doc_id", F.col("_dnorm").alias("norm"),
                    F.length("_dnorm").cast("long").alias("norm_len"))


def map_span(spark, sf_dir):
    """Every normalized position of the separator banner mapped back."""
    v = _views(spark, sf_dir)
    n, lv, dm, de, ol = _cols(v)
    sp = RAG.map_spans(RAG._spans_if(n, RAG.SIGNATURES[20][2], F.lit(True)), n, dm, de, ol)
    return explode_rows(v, ["doc_id"], sp, "s").select(
        "doc_id", F.col("s.start").cast("long").alias("start_pos"), F.col("s.end").cast("long").alias("end_pos"))


def chunk_text(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return explode_rows(d, ["doc_id"], SIM.chunk_spans(F.col("text")), "c").select(
        "doc_id", F.col("c.start").cast("long").alias("start_pos"), F.col("c.end").cast("long").alias("end_pos"))


def signature_spans(spark, sf_dir):
    v = _probed(spark, sf_dir)
    n, lv, dm, de, ol = _cols(v)
    return _spans_of(v, RAG.signature_findings(n, lv, dm, de, ol, held_sql="_held"))


def embedded_spans(spark, sf_dir):
    v = _views(spark, sf_dir)
    n, lv, dm, de, ol = _cols(v)
    return _spans_of(v, RAG.embedded_findings(n, dm, de, ol), with_id=False)


def multilingual_spans(spark, sf_dir):
    return _spans_of(_folded(spark, sf_dir), RAG.multilingual_findings("_fraw"), with_id=False)


def url_spans(spark, sf_dir):
    d = _folded(spark, sf_dir)
    s = explode_rows(d, ["doc_id"], RAG.url_findings(F.col("_fraw")), "f")
    return s.select("doc_id", F.col("f.severity").cast("long").alias("severity"),
                    F.col("f.start").cast("long").alias("start_pos"), F.col("f.end").cast("long").alias("end_pos"))


def encoded_spans(spark, sf_dir):
    return _spans_of(RAG.with_encoded(_docs(spark, sf_dir), "text"), F.col("_enc"), with_id=False)


def doc_signals_q(spark, sf_dir):
    v = _probed(spark, sf_dir)
    has, has_raw = RAG.NORM_PROBES.has(F.col("_held.norm")), RAG.RAW_PROBES.has(F.col("_held.raw"))
    s = explode_rows(v, ["doc_id"], RAG.doc_signals(F.col("_dnorm"), F.col("_fraw"), has, has_raw, F.col("_ev")), "s")
    return s.select("doc_id", F.col("s.category").alias("category"), F.col("s.weight").cast("long").alias("weight"),
                    F.col("s.note").alias("note"))


def _scanned(spark, sf_dir, similarity=False, trusted=False):
    d = _docs(spark, sf_dir)
    return RAG.rag_scan(d, "text", doc_id_col="document_id" if trusted else None,
                        similarity=SIM.with_template_similarity if similarity else None, keep=True)


def documentation_dampening(spark, sf_dir):
    s = _scanned(spark, sf_dir)
    return (explode_rows(s, ["doc_id"], "_damp_f", "f").where("f.dampened")
            .select("doc_id", F.col("f.signature_id").alias("signature_id"),
                    F.col("f.start").cast("long").alias("start_pos"), F.col("f.end").cast("long").alias("end_pos")))


def merge_findings(spark, sf_dir):
    s = _scanned(spark, sf_dir)
    return explode_rows(s, ["doc_id"], "_merged", "f").select(
        "doc_id", F.col("f.signature_id").alias("signature_id"), F.col("f.severity").cast("long").alias("severity"),
        F.col("f.start").cast("long").alias("start_pos"), F.col("f.end").cast("long").alias("end_pos"),
        F.col("f.dampened").alias("dampened"))


def redact_instructions(spark, sf_dir):
    s = _scanned(spark, sf_dir)
    return s.select("doc_id", F.col("rag_injection.sanitized_text").alias("sanitized_text"))


def rag_span_score(spark, sf_dir):
    s = _scanned(spark, sf_dir)
    return s.select("doc_id", RAG.span_score(F.col("_merged")).cast("long").alias("span_score"),
                    F.aggregate("_sig", F.lit(0), lambda a, x: a + x["weight"]).cast("long").alias("doc_score"))


def template_similarity(spark, sf_dir):
    d = _docs(spark, sf_dir)
    s = SIM.with_template_similarity(d, "text", "s")
    return s.select("doc_id", F.round("s.max_similarity", 6).alias("max_similarity"),
                    F.size("s.findings").cast("long").alias("n_hits"))


def vector_similarity(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    v = SIM.vector_similarity(spark, e, e.where("vec_id < 16"))
    return v.select("vec_id", F.round("best_similarity", 6).alias("best_similarity"),
                    "best_template", "is_hit")


def decode_payload(spark, sf_dir):
    d = RAG.with_segments(_docs(spark, sf_dir), "text")           # decoded in the row: no text is copied for each span
    return explode_rows(d, ["doc_id"], F.col("_segs"), "s").select(
        "doc_id", F.col("s.start").cast("long").alias("start_pos"), F.col("s.end").cast("long").alias("end_pos"),
        F.col("s.text").alias("decoded"))


def decode_rescan(spark, sf_dir):
    d = _docs(spark, sf_dir)
    hits = RAG.decode_rescan(d).select(*RAG._TEXT, "severity", "start", "end")
    return (RAG.with_text_key(d, "text").select("doc_id", *RAG._TEXT).join(hits, RAG._TEXT)
            .select("doc_id", F.col("severity").cast("long").alias("severity"),
                    F.col("start").cast("long").alias("start_pos"), F.col("end").cast("long").alias("end_pos")))


def decode_notes(spark, sf_dir):
    """What decoded payloads hold, both levels, in the order of the evidence."""
    d = RAG.with_decoded(_docs(spark, sf_dir), "text")
    return explode_rows(d, ["doc_id"], F.col("_dec_notes"), "note", pos="ord").select(
        "doc_id", F.col("ord").cast("long").alias("ord"), "note")


def trusted_source(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", "document_id", RAG.is_trusted(F.col("document_id")).alias("trusted"))


def imperative_density_q(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", F.round(RAG.imperative_density(D.fold_ws(F.col("text"))), 6).alias("density"))


def confidence_q(spark, sf_dir):
    s = _scanned(spark, sf_dir)
    return s.select("doc_id", F.round("rag_injection.confidence", 6).alias("confidence"))


def doc_decision(spark, sf_dir):
    s = _scanned(spark, sf_dir)
    return s.select("doc_id", "rag_injection.decision", F.col("rag_injection.matched").alias("matched"),
                    F.col("rag_injection.score").cast("long").alias("score"))


def rag_rules(spark, sf_dir):
    """Whole document scan with the rule detectors only (no similarity)."""
    s = _scanned(spark, sf_dir)
    return _flat(s)


def rag_decision_counts(spark, sf_dir):
    """Documents per decision of the rule scan (an aggregate straight on the scan's output)."""
    return (_scanned(spark, sf_dir).groupBy(F.col("rag_injection.decision").alias("decision"))
            .agg(F.count("*").alias("n_docs"), F.sum("rag_injection.score").cast("long").alias("sum_score")))


def rag_blocked(spark, sf_dir):
    """Documents that the rule scan does not allow (a filter straight on the scan's output)."""
    return (_scanned(spark, sf_dir).where("rag_injection.matched")
            .select("doc_id", F.col("rag_injection.decision").alias("decision"),
                    F.col("rag_injection.sanitized_text").alias("sanitized_text")))


def rag_scan_q(spark, sf_dir):
    """Whole document scan with template similarity and the allow-list on."""
    s = _scanned(spark, sf_dir, similarity=True, trusted=True)
    return _flat(s)


def _flat(s):
    r = F.col("rag_injection")
    return s.select("doc_id", r["matched"].alias("matched"), r["score"].cast("long").alias("score"),
                    r["decision"].alias("decision"), F.round(r["confidence"], 6).alias("confidence"),
                    F.array_join(r["evidence"], " | ").alias("evidence"), r["sanitized_text"].alias("sanitized_text"))


def page_rules(spark, sf_dir):
    """Crawled pages (raw HTML) screened as documents with the rule detectors."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    s = RAG.rag_scan(pages, "text")
    return _flat(s.withColumnRenamed("page_id", "doc_id")).withColumnRenamed("doc_id", "page_id")


QUERIES = {
    "page_rules": page_rules,
    "normalize_with_map": normalize_with_map,
    "map_span": map_span,
    "chunk_text": chunk_text,
    "signature_spans": signature_spans,
    "embedded_spans": embedded_spans,
    "multilingual_spans": multilingual_spans,
    "url_spans": url_spans,
    "encoded_spans": encoded_spans,
    "doc_signals": doc_signals_q,
    "documentation_dampening": documentation_dampening,
    "merge_findings": merge_findings,
    "redact_instructions": redact_instructions,
    "rag_span_score": rag_span_score,
    "template_similarity": template_similarity,
    "vector_similarity": vector_similarity,
    "decode_payload": decode_payload,
    "decode_rescan": decode_rescan,
    "decode_notes": decode_notes,
    "trusted_source": trusted_source,
    "imperative_density": imperative_density_q,
    "confidence": confidence_q,
    "doc_decision": doc_decision,
    "rag_rules": rag_rules,
    "rag_decision_counts": rag_decision_counts,
    "rag_blocked": rag_blocked,
    "rag_scan": rag_scan_q,
}
