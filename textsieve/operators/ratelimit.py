"""Sliding-window-log rate limiting over an event table (batch form).

A call at time ``t`` is counted against every earlier-or-same call of its key in
``(t - w, t]`` (``[t - w, t]`` for the in-memory variant), rejected calls
included; it passes when that count is within the limit.  Per-key windows make
one task per key, and a single app may own a third of all events, so the key is
split into time buckets of one window length: each row's window spans at most
its own and the previous bucket, so the previous bucket is copied in as context
rows (at most 2x the rows) and every bucket is counted independently.  A context
row stands at the time its call leaves the window: the count is a running sum over
the sorted rows, so a bucket costs its sort, however many calls a window holds.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_micros(ts: Column) -> Column:
    """TIMESTAMP_NTZ or TIMESTAMP -> epoch micros (session time zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def window_counts(df: DataFrame, keys: list[str], ts_us: str, order: str, window_s: int,
                  inclusive_start: bool = False, logged: Column | None = None) -> DataFrame:
    """Adds ``win_count``: logged calls of the same key in the window, arrival
    order ``(ts_us, order)``, counting the row itself and no later same-time call.
    ``logged`` marks rows that enter the log (default: all)."""
    w_us = int(window_s * 1_000_000)
    stays = w_us + 1 if inclusive_start else w_us
    one = F.when(logged if logged is not None else F.lit(True), 1).otherwise(0)
    base = df.withColumn("_one", one)
    both = base.withColumn("_own", F.explode(F.when(F.col("_one") == 1, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(1)))))
    own = F.col("_own") == 1
    bucket = F.floor(F.col(ts_us) / F.lit(w_us)).cast("long") + 1 - F.col("_own")
    # a call of the bucket before is in the window from the start until it leaves; one without a time never leaves
    leaves = F.when(F.col(ts_us).isNull(), 0).otherwise(-1)
    both = both.select(*[c if c in keys else F.when(own, F.col(c)).alias(c) for c in df.columns], "_own",
                       bucket.alias("_bucket"), F.when(own, F.col(ts_us)).otherwise(F.col(ts_us) + stays).alias("_at"),
                       F.when(own, F.col("_one")).otherwise(leaves).alias("_step"))
    rows = Window.partitionBy(*keys, "_bucket").orderBy("_at", "_own", order)
    before = F.sum(1 - F.col("_own")).over(rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    since = F.sum("_step").over(rows.rowsBetween(Window.unboundedPreceding, 0))
    return (both.withColumn("win_count", (before + since).cast("long")).where("_own = 1")
            .drop("_bucket", "_own", "_at", "_step"))


def rate_limit(events: DataFrame, app_limit: int, app_window_s: int, user_limit: int,
               user_window_s: int, inclusive_start: bool = False) -> DataFrame:
    """events(event_id, app_id, user_id, ts) -> + app_count, app_ok, user_count, user_ok, allowed.

    The user check only sees calls that passed the app check; calls without a
    user skip it (``user_count``/``user_ok`` null).  No join: the user log is a
    conditional count over the same rows."""
    ev = events.withColumn("ts_us", event_micros(F.col("ts")))
    app = window_counts(ev, ["app_id"], "ts_us", "event_id", app_window_s, inclusive_start)
    app = (app.withColumnRenamed("win_count", "app_count")
           .withColumn("app_ok", F.col("app_count") <= app_limit))
    checked = F.col("app_ok") & F.col("user_id").isNotNull()
    usr = window_counts(app, ["app_id", "user_id"], "ts_us", "event_id", user_window_s,
                        inclusive_start, logged=checked)
    usr = (usr.withColumn("user_count", F.when(checked, F.col("win_count")))
           .withColumn("user_ok", F.col("user_count") <= user_limit).drop("win_count"))
    return usr.withColumn("allowed", F.col("app_ok") & F.coalesce(F.col("user_ok"), F.lit(True)))


def limiter_events(events_table: DataFrame) -> DataFrame:
    """Driver ``events`` table as a call log: app = event_type."""
    return events_table.select("event_id", F.col("event_type").alias("app_id"),
                               F.col("user_id").cast("string").alias("user_id"), "ts")
