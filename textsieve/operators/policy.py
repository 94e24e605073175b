"""Policy: per-tenant thresholds, role/source weights, score combination,
compound tag rules and the final decision (Y1-Y9, S5, S6).

Policy tables are small and fixed (a handful of tenants, weights and rules), so
they are broadcast by construction; every join against them is a broadcast
hash join and adds no shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textsieve.functions import patterns as P


# ------------------------------------------------------------------ tables
def tenant_overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, b, tr) for t, b, tr in P.TENANT_THRESHOLDS],
                                 "tenant_id string, block int, transform int")


def known_tenants(requests: DataFrame) -> DataFrame:
    """The effective policy of ``default``, of every tenant with an override, and of every tenant that a request
    names, with its number of requests (one partially summed aggregation) and whether it has an override."""
    spark = requests.sparkSession
    own = tenant_overrides(spark).select("tenant_id").unionByName(spark.createDataFrame([("default",)], "tenant_id string"))
    seen = (requests.groupBy("tenant_id").agg(F.count("*").alias("n_requests"))
            .unionByName(own.withColumn("n_requests", F.lit(0).cast("long")))
            .groupBy("tenant_id").agg(F.sum("n_requests").alias("n_requests")).where("tenant_id IS NOT NULL"))
    known = own.withColumn("known", F.lit(True))
    return (effective_policy(seen).join(seen, "tenant_id").join(F.broadcast(known), "tenant_id", "left")
            .withColumn("known", F.coalesce("known", F.lit(False))))


def effective_policy(tenants: DataFrame) -> DataFrame:
    """Default policy deep-merged with each tenant's override.

    Unknown tenants get the default values but keep their own id."""
    spark = tenants.sparkSession
    b, tr = P.DEFAULT_THRESHOLDS
    ov = tenant_overrides(spark)
    return (tenants.select("tenant_id").distinct()
            .join(F.broadcast(ov), "tenant_id", "left")
            .select("tenant_id", F.lit(P.POLICY_VERSION).alias("version"),
                    F.coalesce("block", F.lit(b)).alias("block"),
                    F.coalesce("transform", F.lit(tr)).alias("transform")))


def _map(pairs) -> Column:
    return F.create_map(*[x for k, v in pairs for x in (F.lit(k), F.lit(float(v)))])


def role_weight(role: Column) -> Column:
    m = _map(P.ROLE_WEIGHTS)
    return F.coalesce(F.element_at(m, F.coalesce(role, F.lit("default"))),
                      F.element_at(m, F.lit("default")), F.lit(1.0))


def context_weight(source: Column) -> Column:
    m = _map(P.CONTEXT_WEIGHTS)
    key = F.coalesce(F.when(source != "", source), F.lit("prompt"))
    return F.coalesce(F.element_at(m, key), F.element_at(m, F.lit("default")), F.lit(1.0))


def apply_weights(score: Column, matched: Column, role: Column, source: Column) -> Column:
    """Matched results only, ``round(score * role_w * ctx_w)`` clamped to 0..100."""
    w = F.rint(score * role_weight(role) * context_weight(source)).cast("int")
    return F.when(matched, F.greatest(F.lit(0), F.least(F.lit(100), w))).otherwise(score)


def combine_score(scores: Column) -> Column:
    """Y2 over an array of matched, weighted scores: top + sum(int(0.25*rest)), cap 100."""
    top = F.array_max(scores)
    bump = F.aggregate(scores, F.lit(0), lambda a, s: a + F.floor(s * P.CORROBORATION_WEIGHT).cast("int"))
    return F.when(F.size(scores) == 0, F.lit(0)).otherwise(
        F.least(F.lit(100), top + bump - F.floor(top * P.CORROBORATION_WEIGHT).cast("int")))


RULES_DDL = "array<struct<ord:int,tags:array<string>,action:string>>"


def compound_rules_literal() -> Column:
    return F.array(*[F.struct(F.lit(i).alias("ord"), F.array(*[F.lit(t) for t in tags]).alias("tags"),
                              F.lit(a).alias("action")) for i, (tags, a) in enumerate(P.COMPOUND_RULES)])


def compound_action(tags: Column, rules: Column | None = None) -> Column:
    """Action of the first rule whose tags are all among ``tags``."""
    rules = rules if rules is not None else compound_rules_literal()
    fired = F.filter(rules, lambda r: F.size(F.array_except(r["tags"], tags)) == 0)
    return F.try_element_at(fired, F.lit(1))["action"]


def decide(score: Column, block: Column, transform: Column) -> Column:
    """Inclusive thresholds."""
    return F.when(score >= block, "block").when(score >= transform, "transform").otherwise("allow")


# ------------------------------------------------------------------ results
def weighted(results: Column, role: Column, source_of: callable) -> Column:
    return F.transform(results, lambda r: F.struct(
        r["ord"].alias("ord"), r["tag"].alias("tag"), r["matched"].alias("matched"),
        apply_weights(r["score"], r["matched"], role, source_of(r)).alias("score"),
        r["evidence"].alias("evidence"), r["sanitized_text"].alias("sanitized_text")))
