"""Whole-request screening (Y10) and the audit table.

requests(request_id, prompt, tenant_id, user_role, app_id, user_id) and
request_docs(request_id, pos, doc_id, text, source) -> one decision row per
request.  Prompt detectors run on the request rows, the document detector on the
document rows (both map-only); document results are grouped to their request
once (the only shuffle), then weights, combination, rules and thresholds are
column expressions with the policy as literals.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsieve.functions import patterns as P
from textsieve.functions.barrier import computed_once
from textsieve.operators import policy as POL
from textsieve.operators import registry as RG
from textsieve.session import kept


def thresholds(tenant: Column, policy: dict | None = None) -> tuple[Column, Column]:
    """Block/transform thresholds of a tenant; ``policy`` maps tenant -> (block,
    transform) and must hold ``default`` (unknown tenants get its values)."""
    if policy is None:
        policy = {"default": P.DEFAULT_THRESHOLDS, **{n: (b, t) for n, b, t in P.TENANT_THRESHOLDS}}
    b, t = policy["default"]
    bm = F.create_map(*[x for n, (bb, _t) in policy.items() for x in (F.lit(n), F.lit(int(bb)))])
    tm = F.create_map(*[x for n, (_b, tt) in policy.items() for x in (F.lit(n), F.lit(int(tt)))])
    return (F.coalesce(F.element_at(bm, tenant), F.lit(int(b))), F.coalesce(F.element_at(tm, tenant), F.lit(int(t))))


def with_thresholds(requests: DataFrame, policy: DataFrame) -> DataFrame:
    """Adds _block and _transform from a policy table (tenant_id, block, transform); a tenant without a row has
    the values of ``default``."""
    row = policy.where("tenant_id = 'default'").select("block", "transform").first()
    block, transform = row or P.DEFAULT_THRESHOLDS
    own = policy.groupBy("tenant_id").agg(F.min("block").alias("_b"), F.min("transform").alias("_t"))
    return (requests.join(own, "tenant_id", "left")
            .withColumns({"_block": F.coalesce("_b", F.lit(block)), "_transform": F.coalesce("_t", F.lit(transform))})
            .drop("_b", "_t"))


ROLE_WEIGHT_VALUES = sorted({float(w) for _k, w in P.ROLE_WEIGHTS} | {1.0})


def _wkey(w: float) -> str:
    return str(w).replace(".", "_")


def doc_results(request_docs: DataFrame, detectors: list, stored: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(results of every document and detector, per-request aggregates).  ``stored``: see :func:`analyze`.

    The document scan is map-only.  A request's documents are reduced with
    algebraic aggregates only (max, sum, count, bounded tag set): no list of
    documents is ever gathered into one row, so a request owning a third of all
    documents still spreads over tasks (partial aggregation).  The weighted score
    depends on the request's role, so it is pre-computed for every distinct
    role weight of the policy and picked after the join."""
    d = RG.results(request_docs, "text", detectors, "_dresults")
    rows = d.select(
        "request_id", F.col("pos").cast("int").alias("pos"), F.col("doc_id").cast("string").alias("doc_id"),
        "source", F.sha2(F.col("text"), 256).alias("text_hash"), F.col("text").alias("_text"),
        F.explode_outer(computed_once(F.col("_dresults"))).alias("r"))
    r = F.col("r")
    long = rows.select(
        "request_id", "pos", "doc_id", "source", "text_hash", r["ord"].alias("ord"), r["tag"].alias("tag"),
        r["matched"].alias("matched"), r["score"].alias("score"), r["evidence"].alias("evidence"),
        F.coalesce(r["sanitized_text"], F.when(F.col("r").isNull() | (r["ord"] == 0), F.col("_text"))).alias("sanitized_text"),
        *[F.when(r["matched"], F.greatest(F.lit(0), F.least(F.lit(100), F.rint(
            r["score"] * F.lit(w) * POL.context_weight(F.col("source"))).cast("int"))))
          .alias(f"ws_{_wkey(w)}") for w in ROLE_WEIGHT_VALUES])
    if stored:
        long = kept(long if stored == "texts" else long.drop("evidence", "sanitized_text"), "documents")
    first = F.coalesce(F.col("ord"), F.lit(0)) == 0
    aggs = [F.count(F.when(first, 1)).alias("n_docs"), F.count(F.when(F.col("matched"), 1)).alias("n_doc_matched"),
            F.collect_set(F.when(F.col("matched"), F.col("tag"))).alias("doc_tags")]       # as many as detectors at most
    for w in ROLE_WEIGHT_VALUES:
        c = F.col(f"ws_{_wkey(w)}")
        aggs += [F.max(c).alias(f"top_{_wkey(w)}"),
                 F.sum(F.floor(c * P.CORROBORATION_WEIGHT)).cast("long").alias(f"bump_{_wkey(w)}")]
    agg = long.groupBy("request_id").agg(*aggs)
    return long, agg


def _by_role_weight(role_w: Column, prefix: str) -> Column:
    out = F.lit(None)
    for w in ROLE_WEIGHT_VALUES:
        out = F.when(role_w == F.lit(w), F.col(f"{prefix}_{_wkey(w)}")).otherwise(out)
    return out


def analyze(requests: DataFrame, request_docs: DataFrame | None = None, paraphrase: bool = True,
            similarity: bool = True, prob_col: str | None = None, policy: dict | DataFrame | None = None,
            with_docs: bool = False, registry: RG.Registry | None = None, stored: str | None = None):
    """Decision per request: the detectors of ``registry`` (`default_registry` with the given options) in their order.  With ``with_docs`` returns (decisions, documents):
    the per-document table holds each attached document's weighted result and
    sanitized text (the response's document list, in long form).  Who reads both has the documents scanned twice, unless
    their results are ``stored`` on the way: with their "texts", or only their "hashes", without evidence and texts."""
    registry = registry or RG.default_registry(paraphrase, similarity, prob_col)
    p = RG.results(requests, "prompt", registry.of("prompt"), "_presults")
    role = F.col("user_role")
    p = p.withColumn("_presults", POL.weighted(F.col("_presults"), role, lambda r: F.lit("prompt")))
    long = None
    if request_docs is not None:
        long, agg = doc_results(request_docs, registry.of("doc"), stored)
        p = p.join(agg, "request_id", "left")
    else:
        p = p.withColumn("n_docs", F.lit(0).cast("long")).withColumn("n_doc_matched", F.lit(0).cast("long")).withColumn(
            "doc_tags", F.array().cast("array<string>"))
        for w in ROLE_WEIGHT_VALUES:
            p = p.withColumn(f"top_{_wkey(w)}", F.lit(None).cast("int")).withColumn(
                f"bump_{_wkey(w)}", F.lit(None).cast("long"))
    rw = POL.role_weight(role)
    hit = F.filter(F.col("_presults"), lambda r: r["matched"])
    p_scores = F.transform(hit, lambda r: r["score"])
    doc_top = _by_role_weight(rw, "top")
    doc_bump = F.coalesce(_by_role_weight(rw, "bump"), F.lit(0)).cast("int")
    n_doc_hit = F.coalesce(F.col("n_doc_matched"), F.lit(0))
    top = F.greatest(F.coalesce(F.array_max(p_scores), F.lit(-1)), F.coalesce(doc_top, F.lit(-1)))
    p_bump = F.aggregate(p_scores, F.lit(0), lambda a, x: a + F.floor(x * P.CORROBORATION_WEIGHT).cast("int"))
    score = F.when((F.size(p_scores) == 0) & (n_doc_hit == 0), F.lit(0)).otherwise(F.least(
        F.lit(100), top + p_bump + doc_bump - F.floor(top * P.CORROBORATION_WEIGHT).cast("int")))
    tags = F.array_sort(F.array_distinct(F.concat(
        F.transform(hit, lambda r: r["tag"]),
        F.coalesce("doc_tags", F.array().cast("array<string>")))))
    if isinstance(policy, DataFrame):
        p = with_thresholds(p, policy)
        block, transform = F.col("_block"), F.col("_transform")
    else:
        block, transform = thresholds(F.col("tenant_id"), policy)
    reasons = F.transform(hit, lambda r: F.struct(r["tag"].alias("tag"), F.when(
        F.size(r["evidence"]) > 0, F.array_join(r["evidence"], "; "))
        .otherwise(F.concat(r["tag"], F.lit(" matched"))).alias("evidence")))
    prompt_sanitized = F.coalesce(F.try_element_at(F.filter(
        F.col("_presults"), lambda r: r["sanitized_text"].isNotNull()), F.lit(-1))["sanitized_text"], F.col("prompt"))
    # grouped projections: every withColumn re-analyzes the whole (large) plan
    p = p.withColumns({"risk_score": computed_once(score), "risk_tags": computed_once(tags), "reasons": reasons,
                       "sanitized_prompt": prompt_sanitized,
                       "n_docs": F.coalesce(F.col("n_docs"), F.lit(0)).cast("long")})
    p = p.withColumn("compound_action", POL.compound_action(F.col("risk_tags")))
    p = p.withColumn("decision", F.coalesce(F.col("compound_action"),
                                            POL.decide(F.col("risk_score"), block, transform)))
    p = p.withColumnRenamed("_presults", "results").drop(
        *[c for c in p.columns if c.startswith("top_") or c.startswith("bump_")], "n_doc_matched", "doc_tags", "_block", "_transform")
    if not with_docs:
        return p
    if long is None:
        return p, None
    docs = long.select("request_id", "pos", "doc_id", "source", "text_hash", "ord", "tag", "matched",
                       *(() if stored == "hashes" else ("evidence", "sanitized_text")), *[f"ws_{_wkey(w)}" for w in ROLE_WEIGHT_VALUES])
    return p, docs


def sanitized_documents(docs: DataFrame) -> DataFrame:
    """Response document list in long form: one row per (request, document id);
    duplicated ids take the sanitized text of their last occurrence."""
    return (docs.groupBy("request_id", "doc_id")
            .agg(F.min("pos").alias("pos"), F.max_by("sanitized_text", F.when(
                F.col("sanitized_text").isNotNull(), F.struct("pos", F.coalesce("ord", F.lit(0))))).alias("text")))


def doc_reasons(docs: DataFrame) -> DataFrame:
    """Reasons of matched documents (long form, ordered by ``pos``)."""
    return docs.where("matched").select("request_id", "pos", "tag", F.when(
        F.size("evidence") > 0, F.array_join("evidence", "; ")).otherwise(
        F.concat(F.col("tag"), F.lit(" matched"))).alias("evidence"))


def audit_records(decisions: DataFrame, ts: Column | None = None) -> DataFrame:
    """G1: hash-only audit rows (no raw text)."""
    return decisions.select(
        "request_id", "app_id", F.sha2(F.col("user_id"), 256).alias("user_id_hash"),
        F.col("tenant_id").alias("tenant"),
        F.date_format(ts if ts is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.lit(P.POLICY_VERSION).alias("policy_version"),
        F.sha2(F.col("prompt"), 256).alias("prompt_hash"),
        F.col("n_docs").alias("n_context_docs"), F.col("risk_score").alias("score"), "decision",
        F.col("risk_tags").alias("tags"))


def audit_doc_hashes(docs: DataFrame) -> DataFrame:
    """G1, document part: the ordered context-document hashes of each request
    (long form, so no request gathers its documents into one row)."""
    return docs.where("coalesce(ord, 0) = 0").select("request_id", "pos", F.col("text_hash").alias("doc_hash"))


def repeated_inputs(audit: DataFrame) -> DataFrame:
    """Prompts seen more than once, by hash only."""
    return (audit.groupBy("prompt_hash")
            .agg(F.count("*").alias("n"), F.array_sort(F.collect_set("decision")).alias("decisions"))
            .where(F.col("n") > 1))


def hash_lookup(audit: DataFrame, hashes: DataFrame) -> DataFrame:
    """For each customer hash, was it seen and how was it decided."""
    seen = audit.groupBy("prompt_hash").agg(
        F.count("*").alias("n_seen"), F.max(F.col("decision") == "block").alias("ever_blocked"))
    return (hashes.join(seen, hashes["hash"] == seen["prompt_hash"], "left")
            .select("hash", F.coalesce("n_seen", F.lit(0)).alias("n_seen"),
                    F.coalesce("ever_blocked", F.lit(False)).alias("ever_blocked")))
