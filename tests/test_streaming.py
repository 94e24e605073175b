"""Structured Streaming limiter equals the batch limiter (available-now run)."""
from paths import SF01
from textsieve.plans import q_limit
from textsieve.streaming import limiter as LS
from textsieve.streaming import screen as SS


def test_stream_limiter_equals_batch(spark):
    run = SS.new_run_dir(spark, "test-limiter")
    s = LS.run_limiter_stream(spark, SF01, q_limit.APP_LIMIT, q_limit.WINDOW_S, q_limit.USER_LIMIT,
                              q_limit.WINDOW_S, run_dir=run)
    got = {r.event_id: (r.app_ok, r.user_ok, r.app_count) for r in
           s.select("event_id", "app_ok", "user_ok", "app_count").collect()}
    exp = {r.event_id: (r.app_ok, r.user_ok, r.app_count) for r in q_limit._limited(spark, SF01)
           .select("event_id", "app_ok", "user_ok", "app_count").collect()}
    assert got == exp
    assert sum(1 for v in got.values() if not v[0]) == 1453


def test_batched_stream_limiter_equals_batch(spark):
    """Four time-ordered micro-batches, each limited against the previous tail."""
    import os
    from textsieve.streaming import limiter as LSB
    run = SS.new_run_dir(spark, "test-limiter-batched")
    src = LSB.stage_event_chunks(spark, SF01, os.path.join(run, "events"), chunks=4)
    s = LSB.run_limiter_stream_batched(spark, os.path.join(src, "*"), q_limit.APP_LIMIT, q_limit.WINDOW_S,
                                       q_limit.USER_LIMIT, q_limit.WINDOW_S, run_dir=run)
    got = {r.event_id: (r.app_ok, r.user_ok) for r in s.select("event_id", "app_ok", "user_ok").collect()}
    exp = {r.event_id: (r.app_ok, r.user_ok) for r in q_limit._limited(spark, SF01)
           .select("event_id", "app_ok", "user_ok").collect()}
    assert got == exp
