"""Replays of the events table as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming import sessions
from .registry import query, table


def _folder(spark) -> str:
    """A folder that all executors share; a session without one that runs in this process has the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _stream(spark, sf):
    at = f"{sf}/event[s].parquet"  # a pattern: the table may be one file, which a stream does not take as a path
    return sessions.events_stream(spark, at, table(spark, sf, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_window_counts(spark, sf):
    df = sessions.window_counts(_stream(spark, sf), "ts", "1 hour", "10 minutes", "event_type")
    out = sessions.latest(sessions.run_to_end(df, "update", _folder(spark)), "start", "event_type")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")


@query("""
    WITH ev AS (SELECT event_id, user_id AS session, event_type, floor(least(1::DOUBLE, value / 120::DOUBLE) * 10000) / 10000 AS score FROM events),
    s AS (SELECT *, max(CASE WHEN event_type = 'click' THEN score ELSE 0 END) OVER w AS l1, coalesce(arg_max(score, event_id) FILTER (WHERE event_type = 'purchase') OVER w, 0) AS l3 FROM ev WINDOW w AS (PARTITION BY session ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    e AS (SELECT session, min(event_id) FILTER (WHERE l3 > 0.7 AND l1 > 0.3) AS stop FROM s GROUP BY session)
    SELECT s.session, count(*) AS n, max(score) AS overall, max(l1) AS l1_max, stop IS NOT NULL AS terminated FROM s JOIN e ON s.session = e.session WHERE stop IS NULL OR event_id <= stop GROUP BY s.session, stop""")
def streaming_session_state(spark, sf):
    t = F.col("event_type")
    layer = F.when(t == "click", "L1").when(t == "view", "L2").when(t == "purchase", "L3").when(t == "error", "L4").otherwise("L5")
    ev = _stream(spark, sf).select(F.col("user_id").alias("session"), "event_id", "ts", layer.alias("layer"), (F.floor(F.least(F.lit(1.0), F.col("value") / 120.0) * 10000) / 10000).alias("score"))
    out = sessions.latest(sessions.run_to_end(sessions.session_state(ev, "ts"), "update", _folder(spark)), "session")
    return out.select("session", "n", "overall", "l1_max", "terminated")


@query("SELECT strftime(to_timestamp(floor(epoch(ts) / 1800) * 1800 - 1800 * k) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM events, range(0, 2) AS g(k) GROUP BY 1")
def streaming_sliding_counts(spark, sf):
    """Events in windows of an hour that begin every half hour."""
    df = sessions.window_counts(_stream(spark, sf), "ts", "1 hour", "10 minutes", slide="30 minutes")
    out = sessions.latest(sessions.run_to_end(df, "update", _folder(spark)), "start")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("""
    WITH b AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM b)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def streaming_activity(spark, sf):
    """Users' spans of activity with less than six hours between events."""
    df = sessions.activity(_stream(spark, sf), "ts", "6 hours", "1 day", "user_id")
    out = sessions.run_to_end(df, "complete", _folder(spark))
    last = out.agg(F.max("batch").alias("batch"))
    return out.join(F.broadcast(last), "batch").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
