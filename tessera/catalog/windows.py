"""Event-time windows over events, as batch queries with the stream operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.registry import query
from tessera.streaming import events as S


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows_tumbling(t):
    """Hourly counts and sums per type."""
    return S.tumbling(t.events, "1 hour", ["event_type"]).withColumn("total", F.round("total", 4))


@query("SELECT w AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k AS w FROM events, (VALUES (0), (1)) v(k)) GROUP BY 1, 2")
def event_windows_sliding(t):
    """Hourly windows every half hour."""
    return S.sliding(t.events, "1 hour", "30 minutes", ["event_type"]).withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_windows_session(t):
    """Sessions per user, ended by six hours without events."""
    return S.sessions(t.events, "6 hours", ["user_id"])


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, date_trunc('day', ts) AS d FROM events) GROUP BY 1, 2")
def event_deduplication(t):
    """One event per user, type and day."""
    return S.deduplicated(t.events.withColumn("d", F.date_trunc("day", "ts")), ["user_id", "event_type", "d"]).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
