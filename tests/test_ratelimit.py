"""Batch sliding-window limiter against its definition."""
import bisect
import time

import duckdb

from paths import SF01
from textsieve.plans import q_limit


def _defined(sf, inclusive=False):
    """The definition: a call passes while the calls of its window, itself included, are within the limit.
    User calls count only where the app passed."""
    rows = duckdb.connect().execute(
        f"select event_id, event_type, cast(user_id as varchar), epoch_us(ts) from '{sf}/events.parquet' "
        "order by 4, 1").fetchall()
    window = q_limit.WINDOW_S * 10**6
    oldest = bisect.bisect_left if inclusive else bisect.bisect_right

    def within(times, limit):
        return [i + 1 - oldest(times, t - window, 0, i + 1) <= limit for i, t in enumerate(times)]

    app_ok, user_ok = {}, {}
    for app in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == app]
        app_ok |= dict(zip((r[0] for r in own), within([r[3] for r in own], q_limit.APP_LIMIT)))
        for user in {r[2] for r in own} - {None}:
            logged = [r for r in own if r[2] == user and app_ok[r[0]]]
            user_ok |= dict(zip((r[0] for r in logged), within([r[3] for r in logged], q_limit.USER_LIMIT)))
    return {r[0]: (app_ok[r[0]], user_ok.get(r[0])) for r in rows}


def test_limiter_matches_brute_force(spark):
    for inclusive in (False, True):
        exp = _defined(SF01, inclusive)
        got = {r.event_id: (r.app_ok, r.user_ok) for r in q_limit._limited(spark, SF01, inclusive)
               .select("event_id", "app_ok", "user_ok").collect()}
        assert got == exp
    rej = sum(1 for v in _defined(SF01).values() if not v[0])
    assert rej == 1453


def test_a_full_window_is_not_read_again_for_every_call(spark):
    """40,000 calls of one app in one window, twice over: by frames that grow with the window this takes minutes."""
    from pyspark.sql import functions as F

    from textsieve.operators import ratelimit as RL
    n, w = 80_000, 400                                                      # one call each 10 ms: a window holds 40,000
    calls = spark.range(n).select(F.col("id").alias("event_id"), F.lit("a").alias("app"), (F.col("id") * 10_000).alias("us"))
    for inclusive in (False, True):
        t = time.monotonic()
        out = RL.window_counts(calls, ["app"], "us", "event_id", w, inclusive)
        wrong = out.where(F.col("win_count") != F.least(F.col("event_id") + 1, F.lit(40_000 + inclusive))).count()
        assert wrong == 0 and time.monotonic() - t < 15
        assert out.columns == [*calls.columns, "win_count"]


def test_equal_times_missing_times_and_calls_that_are_not_logged(spark):
    from pyspark.sql import functions as F

    from textsieve.operators import ratelimit as RL
    rows = [(1, "a", 5, True), (2, "a", 5, False), (3, "a", 5, True), (4, "a", 1_000_005, True), (5, "a", 1_000_006, False),
            (6, None, 7, True), (7, None, 8, True), (8, "b", None, True), (9, "b", None, True)]
    df = spark.createDataFrame(rows, "id long, app string, us long, ok boolean")
    got = {inc: {r.id: r.win_count for r in RL.window_counts(df, ["app"], "us", "id", 1, inc, F.col("ok")).collect()}
           for inc in (False, True)}
    # calls without a time share a bucket with their own context rows, and count them
    assert got[False] == {1: 1, 2: 1, 3: 2, 4: 1, 5: 1, 6: 1, 7: 2, 8: 3, 9: 4}
    assert got[True] == {1: 1, 2: 1, 3: 2, 4: 3, 5: 1, 6: 1, 7: 2, 8: 3, 9: 4}
