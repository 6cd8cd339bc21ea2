"""Streaming queries, run over a bounded stream of the events table to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiteloom.plans.registry import Family
from kiteloom.sources.stages import shared_folder
from kiteloom.streaming import events as ops
from kiteloom.streaming import timers

FAMILY = Family("streaming")
add = FAMILY.add


def _events(spark, d):
    return ops.read_events(spark, f"{d}/events.parquet")


@add("ss1_ingest", "SELECT event_id, event_type FROM events")
def ss1(spark, d):
    return ops.drain(_events(spark, d).select("event_id", "event_type"), shared_folder(spark))


@add("ss2_accepted", "SELECT event_id, event_type IN ('purchase', 'signup') AS positive FROM events WHERE event_type NOT IN ('error')")
def ss2(spark, d):
    return ops.drain(ops.accepted(_events(spark, d)).select("event_id", "positive"), shared_folder(spark))


@add("ss3_daily_snapshot", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def ss3(spark, d):
    """Counts and sums by day and type, overwritten by each trigger that changes them."""
    daily = ops.daily_counts(_events(spark, d)).select(F.to_date("w.start").alias("day"), "event_type", "n", F.round("value", 4).alias("value"))
    return ops.upserted(daily, shared_folder(spark), ["day", "event_type"])


def _replayed(rows: str) -> str:
    """SQL: rows up to the last watermark, an hour behind the latest row; times in milliseconds."""
    return f"e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events WHERE {rows}), w AS (SELECT max(ms) - 3600000 AS w FROM e), r AS (SELECT e.*, w.w FROM e, w WHERE ms <= w.w)"


@add("ss4_follow_up_beat", f"""WITH {_replayed("event_type IN ('purchase', 'signup')")}, n AS (SELECT *, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS next FROM r),
  s AS (SELECT *, unnest([1, 2, 3]) AS nth FROM n)
  SELECT user_id, make_timestamp(ms * 1000) AS replied_at, nth, make_timestamp((ms + nth * 86400000) * 1000) AS sent_at FROM s WHERE ms + nth * 86400000 <= least(w, coalesce(next, w))""")
def ss4(spark, d):
    """A follow-up a day after each positive reply and each follow-up, three at most, until the next reply."""
    replies = ops.accepted(_events(spark, d)).filter("positive")
    rows = ops.drain(timers.follow_up_beat(replies, ops.LATENESS), shared_folder(spark), timers=True)
    return rows.select("user_id", F.col("replied_at").cast("timestamp_ntz").alias("replied_at"), "nth", F.col("sent_at").cast("timestamp_ntz").alias("sent_at"))


@add("ss5_once", "SELECT event_id FROM events")
def ss5(spark, d):
    doubled = _events(spark, d)
    return ops.drain(ops.once(doubled.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))).select("event_id"), shared_folder(spark))


@add("ss6_sessions", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk FROM events)) GROUP BY user_id, s")
def ss6(spark, d):
    rows = ops.drain(ops.sessions(_events(spark, d)), shared_folder(spark), "complete")
    return rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@add("ss6_stuck_jobs", f"""WITH {_replayed("TRUE")}, b AS (SELECT *, CASE WHEN lag(ms) OVER u IS NULL OR ms - lag(ms) OVER u >= 1800000 THEN 1 ELSE 0 END AS brk FROM r WINDOW u AS (PARTITION BY user_id ORDER BY ms, event_id)),
  s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS s FROM b)
  SELECT user_id, make_timestamp(min(ms) * 1000) AS started_at, make_timestamp(max(ms) * 1000) AS last_at, count(*) AS "rows" FROM s GROUP BY user_id, s HAVING max(ms) + 1800000 <= any_value(w)""")
def ss6_stuck(spark, d):
    """Runs of a user's rows that are declared dead half an hour after the last of them."""
    rows = ops.drain(timers.reap_stuck(_events(spark, d), ops.LATENESS, 30 * 60_000), shared_folder(spark), timers=True)
    return rows.select("user_id", F.col("started_at").cast("timestamp_ntz").alias("started_at"), F.col("last_at").cast("timestamp_ntz").alias("last_at"), "rows")


_DELTA = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN -3 ELSE -1 END"


@add("ss7_counters", f"WITH s AS (SELECT user_id, ts, event_id, sum({_DELTA}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events) SELECT user_id, CAST(max_by(s, (ts, event_id)) - least(0, min(s)) AS BIGINT) AS value FROM s GROUP BY user_id")
def ss7(spark, d):
    rows = _events(spark, d).withColumn("delta", F.expr(_DELTA))
    out = ops.drain(ops.clamped_counters(rows, "delta"), shared_folder(spark), "update")
    return out.groupBy("user_id").agg(F.max_by("value", "epoch").alias("value"))


@add("ss8_progress", "SELECT user_id, max(value) AS progress FROM events GROUP BY user_id")
def ss8(spark, d):
    best = _events(spark, d).groupBy("user_id").agg(F.max("value").alias("progress"))
    return ops.drain(best, shared_folder(spark), "complete")
