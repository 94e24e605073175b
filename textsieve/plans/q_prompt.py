"""Spark queries for the prompt-signal keys (inputs: ``seeded_prompts``)."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsieve.functions.arrays import explode_rows
from textsieve.functions.barrier import computed_once

from textsieve.functions import dialect as D
from textsieve.functions import normalize as N
from textsieve.functions import patterns as P
from textsieve.operators import classifier as CL
from textsieve.operators import prompt as PR
from textsieve.session import ensure_checkpoint_dir
from textsieve.sources.tables import read_table, seeded


def _prompts(spark, sf_dir) -> DataFrame:
    return seeded(spark, sf_dir, "seeded_prompts").select("request_id", "prompt")


def _views(spark, sf_dir) -> DataFrame:
    return PR.add_views(_prompts(spark, sf_dir), "prompt")


def _signals(spark, sf_dir, paraphrase=False) -> DataFrame:
    v = _views(spark, sf_dir)
    v = v.withColumn("_lexical", computed_once(PR.lexical_hits(F.col("_norm"), F.col("_leet"))))
    para = None
    if paraphrase:
        v = PR.with_paraphrases(v)
        para = F.col("_para")
    sig = PR.prompt_signals(F.col("_lexical"), para)
    return explode_rows(v, ["request_id"], sig, "s", pos="pos").select(
        "request_id", "pos", F.col("s.category").alias("category"), F.col("s.weight").alias("weight"),
        F.col("s.evidence").alias("evidence"))


def _ids(spark, sf_dir, category):
    return _signals(spark, sf_dir).where(F.col("category") == category).select("request_id")


def normalize_text(spark, sf_dir):
    return _views(spark, sf_dir).select("request_id", F.col("_norm").alias("norm"))


def leet_view(spark, sf_dir):
    return _views(spark, sf_dir).select("request_id", F.col("_leet").alias("leet"))


def spaced_letters(spark, sf_dir):
    low = F.lower(D.fold_ws(F.col("prompt")))
    return (_prompts(spark, sf_dir)
            .where(F.regexp_count(low, F.lit(D.java(P.SPACED_LETTERS))) > 0)
            .select("request_id", F.regexp_replace(low, N.COLLAPSE_SPACED, "").alias("collapsed")))


def evasion_counts(spark, sf_dir):
    e = N.evasion_counts(D.fold_ws(F.col("prompt")))
    return _prompts(spark, sf_dir).select("request_id", *[
        e[n].cast("long").alias(n) for n in ("homoglyph", "zero_width", "leet_mix", "spaced_letters")])


def sentence_stats(spark, sf_dir):
    norm = F.col("_norm")
    s, v = PR.sentence_count(norm), PR.verb_count(norm)
    return _views(spark, sf_dir).select(
        "request_id", s.cast("long").alias("n_sentences"), v.cast("long").alias("n_verbs"),
        F.round(F.when(s > 0, v / s).otherwise(F.lit(0.0)), 6).alias("density"))


def category_lexical(spark, sf_dir):
    return (_signals(spark, sf_dir).where(F.col("category").isin(PR.CATEGORY_NAMES))
            .select("request_id", "category"))


def paraphrase_match(spark, sf_dir):
    s = _signals(spark, sf_dir, paraphrase=True)
    return (s.where(F.col("evidence")[0].contains("paraphrase_match"))
            .select("request_id", "category",
                    F.regexp_extract(F.col("evidence")[0], "confidence=([0-9.]+)", 1).alias("confidence")))


def paraphrase_candidates(spark, sf_dir):
    """P2, prune step: the word windows of every prompt that may be close enough to a phrase."""
    v = _views(spark, sf_dir)
    v = v.withColumn("_lexical", computed_once(PR.lexical_hits(F.col("_norm"), F.col("_leet"))))
    names = F.array(*[F.lit(n) for n in PR.CATEGORY_NAMES])
    return (PR.with_norm_key(v).select("request_id", *PR._KEY).join(PR.paraphrase_candidates(v), PR._KEY)
            .select("request_id", F.get(names, F.col("category")).alias("category"), "phrase", "window"))


def multilingual_hits(spark, sf_dir):
    return (_signals(spark, sf_dir).where("category = 'multilingual_override'")
            .select("request_id", F.regexp_extract(F.col("evidence")[0], "lang=([a-z]+)", 1).alias("lang")))


def embedded_instruction(spark, sf_dir):
    return _ids(spark, sf_dir, "embedded_instruction")


def structural_delimiter(spark, sf_dir):
    return _ids(spark, sf_dir, "structural_delimiter")


def encoded_payload(spark, sf_dir):
    return (_signals(spark, sf_dir).where("category = 'encoded_payload'")
            .select("request_id", F.explode_outer("evidence").alias("evidence")).where("evidence IS NOT NULL"))


def entropy_tokens(spark, sf_dir):
    toks = F.regexp_extract_all(D.fold_ws(F.col("prompt")), F.lit(D.java(P.LONG_TOKEN)), 0)
    t = explode_rows(_prompts(spark, sf_dir), ["request_id"], toks, "tok").distinct()
    h = PR.shannon_entropy(F.col("tok"))
    return (t.withColumn("h", h).where(F.col("h") >= P.ENTROPY_THRESHOLD)
            .select("request_id", "tok", F.round("h", 6).alias("entropy"), F.length("tok").cast("long").alias("len")))


def url_signal(spark, sf_dir):
    return (_signals(spark, sf_dir).where("category = 'external_instruction_source'")
            .select("request_id", F.col("weight").cast("long").alias("weight")))


def sequence_chain(spark, sf_dir):
    return _ids(spark, sf_dir, "multi_stage_execution_chain")


def role_transition(spark, sf_dir):
    return _ids(spark, sf_dir, "role_transition_spoofing")


def contradiction(spark, sf_dir):
    return _ids(spark, sf_dir, "semantic_contradiction")


def context_stuffing(spark, sf_dir):
    return _ids(spark, sf_dir, "context_window_stuffing")


def obfuscation_evasion(spark, sf_dir):
    return (_signals(spark, sf_dir).where("category = 'obfuscation_evasion'")
            .select("request_id", F.col("weight").cast("long").alias("weight"),
                    F.col("evidence")[0].alias("evidence")))


def statistical_anomaly(spark, sf_dir):
    return (_signals(spark, sf_dir).where("category = 'statistical_anomaly'")
            .select("request_id", F.explode_outer("evidence").alias("evidence")).where("evidence IS NOT NULL"))


def educational_dampening(spark, sf_dir):
    s = _result(spark, sf_dir, paraphrase=False)
    ev = F.try_element_at(F.col("r.evidence"), F.lit(-1))
    return (s.where(F.col("r.matched") & ev.startswith("dampened:"))
            .select("request_id", F.when(ev.contains("educational"), F.lit("educational"))
                    .otherwise(F.concat(F.lit("hedge="), F.regexp_extract(ev, "hedge_factor=([0-9.]+)", 1)))
                    .alias("dampening")))


def _result(spark, sf_dir, paraphrase):
    d = PR.prompt_scan(_prompts(spark, sf_dir), "prompt", paraphrase=paraphrase)
    return d.select("request_id", F.col("prompt_injection").alias("r"))


def _flat(d):
    return d.select("request_id", F.col("r.matched").alias("matched"),
                    F.col("r.score").cast("long").alias("score"), F.col("r.severity").alias("severity"),
                    F.array_join("r.categories", ",").alias("categories"),
                    F.array_join("r.evidence", " | ").alias("evidence"))


def prompt_rules(spark, sf_dir):
    return _flat(_result(spark, sf_dir, paraphrase=False))


def prompt_scan_q(spark, sf_dir):
    return _flat(_result(spark, sf_dir, paraphrase=True))


QUERIES = {
    "normalize_text": normalize_text,
    "leet_view": leet_view,
    "spaced_letters": spaced_letters,
    "evasion_counts": evasion_counts,
    "sentence_stats": sentence_stats,
    "category_lexical": category_lexical,
    "paraphrase_match": paraphrase_match,
    "paraphrase_candidates": paraphrase_candidates,
    "multilingual_hits": multilingual_hits,
    "embedded_instruction": embedded_instruction,
    "structural_delimiter": structural_delimiter,
    "encoded_payload": encoded_payload,
    "entropy_tokens": entropy_tokens,
    "url_signal": url_signal,
    "sequence_chain": sequence_chain,
    "role_transition": role_transition,
    "contradiction": contradiction,
    "context_stuffing": context_stuffing,
    "obfuscation_evasion": obfuscation_evasion,
    "statistical_anomaly": statistical_anomaly,
    "educational_dampening": educational_dampening,
    "prompt_rules": prompt_rules,
    "prompt_scan": prompt_scan_q,
}


def _classified(spark, sf_dir):
    """Prompts with P(injection) of a model that is fitted on labelled documents, stored, and read again."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    CL.write_model(CL.fit(docs.join(labels, "doc_id").select("text", F.col("toxic").alias("label"))), path)
    return CL.score(CL.read_model(spark, path), _views(spark, sf_dir), "_norm")


def semantic_classifier(spark, sf_dir):
    """P(injection) of every prompt from a model trained on labelled documents."""
    s = _classified(spark, sf_dir)
    return s.select("request_id", F.round("p_injection", 6).alias("p_injection"))


def semantic_weight(spark, sf_dir):
    """The classifier probability folded into the prompt score."""
    s = _classified(spark, sf_dir)
    r = PR.prompt_scan(s.drop(*PR.VIEWS), "prompt", paraphrase=False, prob_col="p_injection")
    return r.select("request_id", CL.semantic_weight(F.col("p_injection")).cast("long").alias("semantic_weight"),
                    F.col("prompt_injection.score").cast("long").alias("score"))


QUERIES["semantic_classifier"] = semantic_classifier
QUERIES["semantic_weight"] = semantic_weight
