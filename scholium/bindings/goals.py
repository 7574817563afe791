"""Goals, badges and rankings over events and customers."""

from pyspark.sql import functions as F

from scholium.bindings.canonical import KINDS, activity, learners
from scholium.bindings.registry import EVENTS_NOW, query
from scholium.operators import activity as act
from scholium.operators import feeds
from scholium.operators import goals as op
from scholium.operators import progress as prog


@query("""
WITH done AS (SELECT user_id, round(sum(value), 2) AS done FROM events GROUP BY user_id)
SELECT c_custkey AS learner_id, (200 + c_nationkey * 40)::DOUBLE AS target, coalesce(done, 0) AS done,
       least(100, round(100.0 * coalesce(done, 0) / (200 + c_nationkey * 40), 0)) AS pct,
       coalesce(done, 0) >= 200 + c_nationkey * 40 AS met
FROM customer LEFT JOIN done ON user_id = c_custkey
""")
def goal_attainment(t):
    done = act.study_time(activity(t), "learner_id", "minutes").select("learner_id", F.col("minutes").alias("done"))
    targets = t("customer").select(
        F.col("c_custkey").alias("learner_id"), (200 + F.col("c_nationkey") * 40).cast("double").alias("target")
    )
    return op.goal_attainment(done, targets, "learner_id")


@query("""
WITH parts AS (SELECT user_id, event_type, count(*) AS done FROM events GROUP BY ALL),
met AS (SELECT user_id, count(*) FILTER (done >= 12) AS met, count(*) AS parts FROM parts GROUP BY user_id)
SELECT user_id AS learner_id, met, parts, met::VARCHAR || '/' || parts::VARCHAR || ' done' AS label,
       round(100.0 * met / parts, 0) AS pct
FROM met
""")
def goals_met(t):
    parts = activity(t).groupBy("learner_id", "kind").agg(F.count("*").alias("done")).withColumn("target", F.lit(12))
    return op.goals_met(parts, "learner_id")


BADGES = [
    ("First Steps", "n", 1.0),
    ("Regular", "n", 60.0),
    ("Marathon", "minutes", 1000.0),
    ("Quiz Master", "purchases", 12.0),
]


@query("""
WITH m AS (
  SELECT user_id, count(*) AS n, round(sum(value), 2) AS minutes, count(*) FILTER (event_type = 'purchase') AS purchases
  FROM events GROUP BY user_id
), b AS (
  SELECT user_id, list_filter([CASE WHEN n >= 1 THEN 'First Steps' END, CASE WHEN n >= 60 THEN 'Regular' END,
    CASE WHEN minutes >= 1000 THEN 'Marathon' END, CASE WHEN purchases >= 12 THEN 'Quiz Master' END],
    lambda x: x IS NOT NULL) AS earned
  FROM m
)
SELECT user_id AS learner_id, array_to_string(earned, ', ') AS badges, len(earned)::BIGINT AS n_badges FROM b
""")
def award_badges(t):
    metrics = activity(t).groupBy("learner_id").agg(
        F.count("*").alias("n"),
        F.round(F.sum("minutes"), 2).alias("minutes"),
        F.count_if(F.col("kind") == "purchase").alias("purchases"),
    )
    return op.award_badges(metrics, "learner_id", BADGES)


@query("""
WITH totals AS (SELECT user_id, round(sum(value), 2) AS points FROM events GROUP BY user_id),
ranked AS (SELECT *, rank() OVER (ORDER BY points DESC) AS rank FROM totals)
SELECT user_id AS learner_id, points, rank, '#' || rank::VARCHAR AS rank_label,
       CASE rank WHEN 1 THEN '🥇' WHEN 2 THEN '🥈' WHEN 3 THEN '🥉' ELSE '⭐' END AS medal
FROM ranked WHERE rank <= 10
""")
def leaderboard(t):
    return op.leaderboard(activity(t), "learner_id", "minutes", 10)


@query("""
WITH totals AS (
  SELECT user_id, count(*)::DOUBLE AS points FROM events
  WHERE ts >= TIMESTAMP '2024-01-29 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00' GROUP BY user_id
), ranked AS (SELECT *, rank() OVER (ORDER BY points DESC) AS rank FROM totals)
SELECT user_id AS learner_id, points, rank, '#' || rank::VARCHAR AS rank_label,
       CASE rank WHEN 1 THEN '🥇' WHEN 2 THEN '🥈' WHEN 3 THEN '🥉' ELSE '⭐' END AS medal
FROM ranked WHERE rank <= 5
""")
def weekly_leaderboard(t):
    this_week = act.in_period(activity(t), "ts", "week", EVENTS_NOW).withColumn("points", F.lit("1"))
    return op.leaderboard(this_week, "learner_id", "points", 5)


@query("""
WITH totals AS (SELECT user_id, round(sum(value), 2) AS points FROM events GROUP BY user_id),
ranked AS (SELECT *, rank() OVER (ORDER BY points DESC) AS rank, count(*) OVER () AS learners FROM totals)
SELECT user_id AS learner_id, points, rank, '#' || rank::VARCHAR AS rank_label, learners FROM ranked WHERE user_id = 8
""")
def own_rank(t):
    return op.own_rank(activity(t), "learner_id", "minutes", 8)


@query("""
WITH totals AS (SELECT user_id, round(sum(value), 2) AS points FROM events GROUP BY user_id),
ranked AS (SELECT *, rank() OVER (ORDER BY points DESC) AS rank FROM totals)
SELECT user_id AS learner_id, points, rank, '#' || rank::VARCHAR AS rank_label,
       CASE rank WHEN 1 THEN '🥇' WHEN 2 THEN '🥈' WHEN 3 THEN '🥉' ELSE '⭐' END AS medal, c_name AS name
FROM ranked JOIN customer ON c_custkey = user_id WHERE rank <= 10
""")
def with_learner_name(t):
    return feeds.with_learner_name(op.leaderboard(activity(t), "learner_id", "minutes", 10), learners(t), "learner_id")


@query("""
SELECT user_id AS learner_id, count(*) AS n, round(sum(value), 2) AS minutes
FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) GROUP BY user_id
""")
def visible_only(t):
    totals = activity(t).groupBy("learner_id").agg(F.count("*").alias("n"), F.round(F.sum("minutes"), 2).alias("minutes"))
    return feeds.visible_only(totals, learners(t), "learner_id")


@query("""
SELECT user_id AS learner_id, count(*) AS n,
       coalesce(max(CASE WHEN c_acctbal >= 0 THEN c_name END), 'Student') AS name
FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY user_id
""")
def mask_hidden(t):
    totals = activity(t).groupBy("learner_id").agg(F.count("*").alias("n"))
    return feeds.mask_hidden(totals, learners(t), "learner_id")


PROGRESS = """
WITH progress AS (
  SELECT user_id AS learner_id, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS area,
         count(DISTINCT event_type) AS items_done, round(100.0 * count(DISTINCT event_type) / 5, 4) AS progress
  FROM events GROUP BY ALL
)
"""


def _progress(t):
    from scholium.bindings.canonical import subject_areas

    return prog.subject_progress(subject_areas(t), "learner_id", "area", "kind", len(KINDS))


@query(PROGRESS + "SELECT * FROM progress")
def subject_progress(t):
    return _progress(t)


@query(PROGRESS + """
SELECT learner_id, round(avg(progress), 0) AS overall, count(*) AS subjects FROM progress GROUP BY learner_id
""")
def overall_progress(t):
    return prog.overall_progress(_progress(t), "learner_id")


@query(PROGRESS + "SELECT learner_id, count(*) FILTER (progress >= 100) AS completed FROM progress GROUP BY learner_id")
def courses_completed(t):
    return prog.courses_completed(_progress(t), "learner_id")


@query(PROGRESS + """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY progress, area) AS position FROM progress
) WHERE position <= 3
""")
def weak_topics(t):
    return prog.weak_topics(_progress(t), "learner_id", "area", 3)


@query(PROGRESS + """
, last AS (
  SELECT user_id AS learner_id, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS area, ts AS last_seen FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events
  ) WHERE rn = 1
)
, pace AS (
  SELECT learner_id, area, sum(pow(0.5, date_diff('day', first::DATE, DATE '2024-01-31') / 14.0)) * ln(2) / 14 AS pace FROM (
    SELECT user_id AS learner_id, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS area, event_type, min(ts) AS first
    FROM events GROUP BY ALL
  ) GROUP BY ALL
)
SELECT l.learner_id, l.area, l.last_seen, p.items_done, p.progress,
       round(CASE WHEN p.items_done >= 5 THEN 0 ELSE (5 - p.items_done) / r.pace END, 2) AS days_left
FROM last l LEFT JOIN progress p ON p.learner_id = l.learner_id AND p.area = l.area
LEFT JOIN pace r ON r.learner_id = l.learner_id AND r.area = l.area
""")
def continue_learning(t):
    from scholium.bindings.canonical import subject_areas

    pace = prog.learning_pace(subject_areas(t), "learner_id", "area", "kind", "ts", EVENTS_NOW)
    return prog.continue_learning(subject_areas(t), _progress(t), "learner_id", "area", "ts", "event_id", pace, 5)
