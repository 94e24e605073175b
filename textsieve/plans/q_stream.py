"""Streaming keys."""
from __future__ import annotations

import os

from pyspark.sql import functions as F

from textsieve.functions import patterns as P
from textsieve.plans import q_limit
from textsieve.streaming import limiter as LS
from textsieve.streaming import screen as SS


def rate_limit_stream(spark, sf_dir):
    """The events replayed as a stream of time-ordered files; every
    micro-batch is limited against the previous window's tail (no per-app
    groups, so a hot app never lands in one task)."""
    run = SS.new_run_dir(spark, "limiter")
    src = LS.stage_event_chunks(spark, sf_dir, os.path.join(run, "events"), chunks=4)
    v = LS.run_limiter_stream_batched(spark, os.path.join(src, "*"), q_limit.APP_LIMIT, q_limit.WINDOW_S,
                                      q_limit.USER_LIMIT, q_limit.WINDOW_S, run_dir=run)
    return v.select("event_id", "app_count", "app_ok", "user_count", "user_ok")


def rate_limit_stream_state(spark, sf_dir):
    """W4, keyed state by (app, time bucket) that expires when the watermark passes the bucket."""
    run = SS.new_run_dir(spark, "limiter-state")
    src = LS.stage_event_chunks(spark, sf_dir, os.path.join(run, "events"), chunks=4)
    v = LS.run_limiter_stream(spark, os.path.join(src, "*"), q_limit.APP_LIMIT, q_limit.WINDOW_S, q_limit.USER_LIMIT,
                              q_limit.WINDOW_S, files_glob="*.parquet", run_dir=run)
    return v.select("event_id", "app_count", "app_ok", "user_count", "user_ok")


def _staged(spark, sf_dir, name):
    run = SS.new_run_dir(spark, name)
    parts = SS.stage_requests(spark, sf_dir, os.path.join(run, "requests"), parts=2)
    return run, parts


def screen_stream(spark, sf_dir):
    """Requests screened as they arrive, the files of an arrival in a micro-batch, however many it was written as;
    audit rows appended per batch."""
    run, parts = _staged(spark, sf_dir, "screen")
    policy = os.path.join(run, "policy")
    SS.write_policy(spark, policy, {"default": P.DEFAULT_THRESHOLDS,
                                    **{n: (b, t) for n, b, t in P.TENANT_THRESHOLDS}})
    # rule detectors (no paraphrase model, no similarity), so the streamed
    # decisions are checked against the end-to-end rule oracle
    audit = SS.run_screen_stream(spark, os.path.join(run, "requests", "*"), policy, run, paraphrase=False,
                                 similarity=False, files_per_batch=max(SS.n_files(spark, p) for p in parts))
    return audit.select("request_id", "tenant", "decision", F.col("score").cast("long").alias("score"),
                        F.array_join("tags", ",").alias("tags"))


def policy_refresh(spark, sf_dir):
    """The policy table is re-read per micro-batch: an edit between two
    arrivals changes the decisions of the second arrival only."""
    run, parts = _staged(spark, sf_dir, "refresh")
    policy = os.path.join(run, "policy")
    incoming = os.path.join(run, "incoming")
    base = {"default": P.DEFAULT_THRESHOLDS, **{n: (b, t) for n, b, t in P.TENANT_THRESHOLDS}}
    out = None
    for gen, part in enumerate(parts):
        strict = {k: (max(1, b - 40 * gen), max(1, t - 40 * gen)) for k, (b, t) in base.items()}
        SS.write_policy(spark, policy, strict)
        spark.read.text(part).write.mode("overwrite").text(os.path.join(incoming, f"batch{gen}"))
        audit = SS.run_screen_stream(spark, os.path.join(incoming, "*"), policy, run, paraphrase=False, similarity=False,
                                     files_per_batch=SS.n_files(spark, os.path.join(incoming, f"batch{gen}")))
        out = audit
    return out.select("request_id", "tenant", "decision", F.col("score").cast("long").alias("score"))


def window_rollup(spark, sf_dir):
    """W7 in batch form: limiter decisions per 1-hour window sliding by 15 minutes."""
    v = q_limit._limited(spark, sf_dir)
    return SS.window_rollup(v)


QUERIES = {
    "rate_limit_stream": rate_limit_stream,
    "rate_limit_stream_state": rate_limit_stream_state,
    "screen_stream": screen_stream,
    "policy_refresh": policy_refresh,
    "window_rollup": window_rollup,
}


def oracle() -> dict[str, str]:
    from textsieve.plans import q_policy
    base = q_limit._oracle(False)
    return {
        "policy_refresh": _policy_refresh_oracle(),
        "screen_stream": ("SELECT request_id, tenant_id AS tenant, decision, risk_score AS score, risk_tags AS tags FROM ("
                          + q_policy.analyze_rules_oracle() + ")"),
        "rate_limit_stream_state": base + f"""SELECT a.event_id, a.app_count, a.app_count <= {q_limit.APP_LIMIT} AS app_ok,
            u.user_count, u.user_count <= {q_limit.USER_LIMIT} AS user_ok FROM a LEFT JOIN u ON u.event_id = a.event_id""",
        "rate_limit_stream": base + f"""SELECT a.event_id, a.app_count, a.app_count <= {q_limit.APP_LIMIT} AS app_ok,
            u.user_count, u.user_count <= {q_limit.USER_LIMIT} AS user_ok FROM a LEFT JOIN u ON u.event_id = a.event_id""",
        "window_rollup": base + f""", v AS (SELECT a.event_id, a.app_id, e.ts,
              a.app_count <= {q_limit.APP_LIMIT} AND coalesce(u.user_count <= {q_limit.USER_LIMIT}, true) AS allowed
            FROM a LEFT JOIN u ON u.event_id = a.event_id JOIN events e ON e.event_id = a.event_id)
            SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE, '%Y-%m-%d %H:%M:%S') AS window_start,
                   app_id, allowed, count(*) AS n
            FROM v, (SELECT unnest(range(0, 4)) AS k)
            GROUP BY 1, 2, 3""",
    }


def _policy_refresh_oracle() -> str:
    """Arrival k (conversation id parity) is screened under thresholds lowered by 40*k."""
    from textsieve.plans import q_policy as QP
    gen = "(CAST(split_part(request_id, '-', 1) AS BIGINT) % 2)"
    blk = f"greatest(1, ({QP._tenant_case('tenant_id', 0)}) - 40 * {gen})"
    trn = f"greatest(1, ({QP._tenant_case('tenant_id', 1)}) - 40 * {gen})"
    return (f"SELECT request_id, tenant_id AS tenant, coalesce(compound_action, CASE WHEN risk_score >= {blk} "
            f"THEN 'block' WHEN risk_score >= {trn} THEN 'transform' ELSE 'allow' END) AS decision, "
            f"risk_score AS score FROM (" + QP.analyze_rules_oracle() + ")")
