"""Rate-limit keys over ``events`` (app = event_type) and their oracle SQL.

Fixture limits: the full-size limits (600/60 s, 60/60 s) never trip on the test
events, so the checks run with a one-day window, app limit 75, user limit 3.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from textsieve.operators import ratelimit as RL
from textsieve.sources.tables import read_table

WINDOW_S = 86_400
APP_LIMIT = 75
USER_LIMIT = 3


def _limited(spark, sf_dir, inclusive=False):
    ev = RL.limiter_events(read_table(spark, sf_dir, "events"))
    return RL.rate_limit(ev, APP_LIMIT, WINDOW_S, USER_LIMIT, WINDOW_S, inclusive_start=inclusive)


def rate_limit_app(spark, sf_dir):
    return _limited(spark, sf_dir).select("event_id", "app_id", "app_count", "app_ok")


def rate_limit_user(spark, sf_dir):
    return (_limited(spark, sf_dir).where(F.col("user_count").isNotNull())
            .select("event_id", "app_id", "user_id", "user_count", "user_ok"))


def rate_limit_memory(spark, sf_dir):
    return _limited(spark, sf_dir, inclusive=True).select(
        "event_id", "app_count", "app_ok", "user_count", "allowed")


QUERIES = {
    "rate_limit_app": rate_limit_app,
    "rate_limit_user": rate_limit_user,
    "rate_limit_memory": rate_limit_memory,
}


def _oracle(inclusive: bool) -> str:
    w = WINDOW_S * 1_000_000 - (0 if inclusive else 1)
    return f"""WITH ev AS (SELECT event_id, event_type AS app_id, CAST(user_id AS VARCHAR) AS user_id,
       epoch_us(ts) AS ts_us FROM events),
a AS (SELECT *, count(*) OVER (PARTITION BY app_id ORDER BY ts_us RANGE BETWEEN {w} PRECEDING AND CURRENT ROW)
     - (count(*) OVER (PARTITION BY app_id, ts_us)
        - row_number() OVER (PARTITION BY app_id, ts_us ORDER BY event_id)) AS app_count FROM ev),
u AS (SELECT event_id, count(*) OVER (PARTITION BY app_id, user_id ORDER BY ts_us
        RANGE BETWEEN {w} PRECEDING AND CURRENT ROW)
     - (count(*) OVER (PARTITION BY app_id, user_id, ts_us)
        - row_number() OVER (PARTITION BY app_id, user_id, ts_us ORDER BY event_id)) AS user_count
      FROM a WHERE app_count <= {APP_LIMIT} AND user_id IS NOT NULL)
"""


def oracle() -> dict[str, str]:
    return {
        "rate_limit_app": _oracle(False) + f"SELECT event_id, app_id, app_count, app_count <= {APP_LIMIT} AS app_ok FROM a",
        "rate_limit_user": _oracle(False) + f"""SELECT a.event_id, a.app_id, a.user_id, u.user_count,
            u.user_count <= {USER_LIMIT} AS user_ok FROM u JOIN a ON a.event_id = u.event_id""",
        "rate_limit_memory": _oracle(True) + f"""SELECT a.event_id, a.app_count, a.app_count <= {APP_LIMIT} AS app_ok,
            u.user_count, a.app_count <= {APP_LIMIT} AND coalesce(u.user_count <= {USER_LIMIT}, true) AS allowed
            FROM a LEFT JOIN u ON u.event_id = a.event_id""",
    }
