"""Activity metrics over events."""

from datetime import timedelta

from scholium.bindings.canonical import KINDS, activity, learners
from scholium.bindings.registry import EVENTS_NOW, query
from scholium.functions import times
from scholium.operators import activity as op


@query("""
SELECT user_id AS learner_id,
       count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error,
       count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup,
       count(*) FILTER (event_type = 'view') AS view
FROM events GROUP BY user_id
""")
def activity_counts(t):
    return op.activity_counts(activity(t), "learner_id", "kind", KINDS)


@query("""
WITH m AS (SELECT user_id, round(sum(value), 2) AS minutes FROM events GROUP BY user_id),
     h AS (SELECT *, floor(minutes)::BIGINT AS whole, (round(minutes * 100)::BIGINT + 300) // 600 AS tenths FROM m)
SELECT user_id AS learner_id, minutes,
       (whole // 60)::VARCHAR || 'h ' || lpad((whole % 60)::VARCHAR, 2, '0') || 'm' AS time_hm,
       (tenths // 10)::VARCHAR || '.' || (tenths % 10)::VARCHAR || 'h' AS time_hours
FROM h
""")
def study_time(t):
    return op.study_time(activity(t), "learner_id", "minutes")


@query("""
SELECT 'today' AS period, event_id, ts, user_id AS learner_id FROM events
WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' AND ts < TIMESTAMP '2024-01-30 18:00:00'
UNION ALL
SELECT 'week', event_id, ts, user_id FROM events
WHERE ts >= TIMESTAMP '2024-01-29 00:00:00' AND ts < TIMESTAMP '2024-01-30 18:00:00'
UNION ALL
SELECT 'month', event_id, ts, user_id FROM events
WHERE ts >= TIMESTAMP '2024-01-01 00:00:00' AND ts < TIMESTAMP '2024-01-30 18:00:00'
""")
def in_period(t):
    from pyspark.sql import functions as F

    rows = activity(t).select("event_id", "ts", "learner_id")
    parts = [
        op.in_period(rows, "ts", period, "2024-01-30 18:00:00").select(F.lit(period).alias("period"), "*")
        for period in ("today", "week", "month")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
WITH weekly AS (
  SELECT user_id, date_trunc('week', ts)::DATE AS period, round(sum(value), 2) AS total FROM events GROUP BY ALL
), spine AS (
  SELECT user_id, unnest(generate_series(min(period), DATE '2024-01-29', INTERVAL 7 DAY))::DATE AS period
  FROM weekly GROUP BY user_id
), filled AS (
  SELECT s.user_id, s.period, coalesce(w.total, 0) AS total
  FROM spine s LEFT JOIN weekly w ON w.user_id = s.user_id AND w.period = s.period
), lagged AS (
  SELECT *, lag(total) OVER (PARTITION BY user_id ORDER BY period) AS previous FROM filled
)
SELECT user_id AS learner_id, period, total, previous,
       CASE WHEN previous <> 0 THEN round(100.0 * (total - previous) / previous, 4) END AS change_pct
FROM lagged
""")
def period_change(t):
    return op.period_change(activity(t), "learner_id", "ts", "minutes", "week", EVENTS_NOW)


@query("""
WITH daily AS (SELECT user_id, ts::DATE AS day, sum(value) AS total FROM events GROUP BY ALL),
spine AS (
  SELECT user_id, unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS day
  FROM (SELECT DISTINCT user_id FROM events)
)
SELECT s.user_id AS learner_id, s.day, round(coalesce(d.total, 0), 2) AS total
FROM spine s LEFT JOIN daily d ON d.user_id = s.user_id AND d.day = s.day
""")
def daily_series(t):
    return op.daily_series(activity(t), "learner_id", "ts", "minutes", "2024-01-01", EVENTS_NOW)


@query("""
WITH daily AS (
  SELECT user_id, ts::DATE AS day, sum(value) AS total FROM events
  WHERE ts >= TIMESTAMP '2024-01-22 00:00:00' AND ts < TIMESTAMP '2024-01-29 00:00:00' GROUP BY ALL
), spine AS (
  SELECT c_custkey AS user_id, unnest(generate_series(DATE '2024-01-22', DATE '2024-01-28', INTERVAL 1 DAY))::DATE AS day
  FROM customer
)
SELECT s.user_id AS learner_id, s.day, round(coalesce(d.total, 0), 2) AS total
FROM spine s LEFT JOIN daily d ON d.user_id = s.user_id AND d.day = s.day
""")
def daily_series_all_learners(t):
    return op.daily_series(
        activity(t), "learner_id", "ts", "minutes", "2024-01-22", "2024-01-29", learners(t)
    )


@query("""
SELECT (isodow(ts) - 1)::BIGINT AS weekday, strftime(ts, '%a') AS label, round(sum(value), 2) AS total, count(*) AS n
FROM events GROUP BY ALL
""")
def weekday_profile(t):
    return op.weekday_profile(activity(t), "ts", "minutes")


@query("""
WITH days AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events),
runs AS (
  SELECT user_id, max(day) AS last_day, count(*) AS n
  FROM (SELECT *, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INTEGER AS anchor FROM days)
  GROUP BY user_id, anchor
)
SELECT user_id AS learner_id, max(CASE WHEN last_day >= DATE '2024-01-30' THEN n ELSE 0 END) AS current_streak,
       max(n) AS longest_streak
FROM runs GROUP BY user_id
""")
def study_streak(t):
    return op.study_streak(activity(t), "learner_id", "ts", EVENTS_NOW)


@query("""
SELECT event_id, ts, user_id AS learner_id, event_type AS kind, position FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS position FROM events
) WHERE position <= 5
""")
def recent_activity(t):
    rows = activity(t).select("event_id", "ts", "learner_id", "kind")
    return op.recent_activity(rows, "learner_id", "ts", "event_id", 5)


@query("""
WITH days AS (
  SELECT DISTINCT user_id, ts::DATE AS day FROM events
  WHERE ts >= TIMESTAMP '2024-01-17 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00'
), counted AS (
  SELECT user_id, count(*) FILTER (day >= DATE '2024-01-24') AS a, count(*) FILTER (day < DATE '2024-01-24') AS b
  FROM days GROUP BY user_id
)
SELECT user_id AS learner_id, a AS active_days, b AS active_days_before, round(100.0 * a / 7, 4) AS consistency_pct,
       round(100.0 * b / 7, 4) AS consistency_before_pct, round(100.0 * (a - b) / 7, 4) AS change_points
FROM counted
""")
def consistency_change(t):
    return op.consistency_change(activity(t), "learner_id", "ts", EVENTS_NOW)


@query("""
WITH first AS (SELECT user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS subject, min(ts) AS ts FROM events GROUP BY ALL)
SELECT user_id AS learner_id, count(*) AS new_concepts FROM first WHERE ts::DATE = DATE '2024-01-30' GROUP BY user_id
""")
def new_concepts(t):
    return op.new_concepts(activity(t), "learner_id", "subject", "ts", "2024-01-30")


SESSIONS = """
WITH gaps AS (
  SELECT user_id, ts, value,
         CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 4 HOUR THEN 1 ELSE 0 END AS brk
  FROM events
), numbered AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM gaps),
sessions AS (
  SELECT user_id AS learner_id, min(ts) AS session_start, max(ts) AS last_activity, count(*) AS n,
         round(sum(value), 2) AS minutes
  FROM numbered GROUP BY user_id, session
)
"""


@query(SESSIONS + "SELECT * FROM sessions")
def focus_sessions(t):
    return op.focus_sessions(activity(t), "learner_id", "ts", "minutes", timedelta(hours=4))


@query(SESSIONS + """
SELECT learner_id, session_start::DATE AS day, count(*) AS sessions, round(sum(minutes), 2) AS minutes
FROM sessions GROUP BY ALL
""")
def focus_time_per_day(t):
    sessions = op.focus_sessions(activity(t), "learner_id", "ts", "minutes", timedelta(hours=4))
    return op.focus_time_per_day(sessions, "learner_id")


@query("""
WITH aged AS (
  SELECT event_id, ts, date_sub('minute', ts, TIMESTAMP '2024-01-30 18:00:00') AS m,
         date_diff('day', ts::DATE, DATE '2024-01-30') AS d
  FROM events
)
SELECT event_id, CASE WHEN ts > TIMESTAMP '2024-01-30 18:00:00' THEN NULL
  WHEN m < 1 THEN 'Just now'
  WHEN m < 60 THEN m::VARCHAR || CASE WHEN m = 1 THEN ' minute ago' ELSE ' minutes ago' END
  WHEN d = 0 AND m < 720 THEN (m // 60)::VARCHAR || CASE WHEN m // 60 = 1 THEN ' hour ago' ELSE ' hours ago' END
  WHEN d = 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' ELSE d::VARCHAR || ' days ago' END AS age
FROM aged
""")
def relative_time(t):
    return t("events").select("event_id", times.relative_time("ts", "2024-01-30 18:00:00").alias("age"))
