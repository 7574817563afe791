"""Streams run over the event and conversation tables until their input is used up."""

from pyspark.sql import functions as F

from scholium.bindings.content import _trim
from scholium.bindings.registry import query
from scholium.plans import scratch_dir
from scholium.sources import KeyedTable, event_stream, parquet_stream
from scholium.streaming import feeds, sinks

DELAY = "1 day"


def _events(t):
    return event_stream(t.spark, t.path("events")).select(
        "event_id", "ts", F.col("user_id").alias("learner_id"), F.col("value").alias("minutes")
    )


@query("""
SELECT user_id AS learner_id, ts::DATE AS day, round(sum(value), 2) AS total, count(*) AS n FROM events GROUP BY ALL
""")
def stream_daily_activity(t):
    totals = feeds.daily_activity(_events(t), "learner_id", "ts", "minutes", DELAY)
    target = scratch_dir(t.spark, "daily")
    table = KeyedTable(t.spark, f"{target}/table", ["learner_id", "day"], buckets=8)
    sinks.upsert_table(totals, table, f"{target}/state").awaitTermination()
    return table.read()


@query("SELECT event_id, ts, user_id AS learner_id FROM events")
def stream_dedup(t):
    twice = _events(t).unionByName(_events(t))
    kept = feeds.dedup(twice, "ts", ["event_id"], "60 days")
    return sinks.run_to_end(kept.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "learner_id"), "dedup")


@query("""
WITH gaps AS (
  SELECT user_id, ts, value,
         CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 4 HOUR THEN 1 ELSE 0 END AS brk
  FROM events
), numbered AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM gaps)
SELECT user_id AS learner_id, min(ts) AS session_start, max(ts) AS last_activity, count(*) AS n,
       round(sum(value), 2) AS minutes
FROM numbered GROUP BY user_id, session
HAVING max(ts) + INTERVAL 4 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY
""")
def stream_sessions(t):
    return sinks.run_to_end(feeds.sessions(_events(t), "learner_id", "ts", "minutes", "4 hours", DELAY), "sessions")


@query("""
WITH days AS (
  SELECT DISTINCT user_id, ts::DATE AS day FROM events
  WHERE ts::DATE + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY
), runs AS (
  SELECT user_id, min(day) AS first_day, count(*) AS n
  FROM (SELECT *, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INTEGER AS anchor FROM days)
  GROUP BY user_id, anchor
)
SELECT user_id AS learner_id, first_day + (streak - 1)::INTEGER AS day, streak::BIGINT AS streak
FROM runs, (VALUES (3), (7), (14)) m(streak) WHERE n >= streak
""")
def stream_milestones(t):
    return sinks.run_to_end(feeds.milestones(_events(t), "learner_id", "ts", [3, 7, 14], DELAY), "milestones")


@query(f"SELECT conv_id, turn, role, {_trim('text')} AS text FROM conversations WHERE length({_trim('text')}) > 0")
def stream_messages(t):
    return sinks.run_to_end(feeds.messages(parquet_stream(t.spark, t.path("conversations"))), "messages")
