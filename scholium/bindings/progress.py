"""Quizzes over lineitem and orders; the weekly report over events."""

from pyspark.sql import functions as F

from scholium.bindings.canonical import activity, answers, attempts
from scholium.bindings.registry import query
from scholium.operators import progress as op

SCORES = """
WITH scores AS (
  SELECT l_orderkey AS quiz_id, count(*) FILTER (l_returnflag = 'A') AS correct, count(*) AS total
  FROM lineitem GROUP BY l_orderkey
), taken AS (
  SELECT quiz_id, o_custkey AS learner_id, o_orderdate AS ts, correct, total
  FROM scores JOIN orders ON o_orderkey = quiz_id
)
"""


def _taken(t):
    # Answers shrink to one row per quiz before they meet the attempts.
    return op.quiz_scores(answers(t), ["quiz_id"]).join(attempts(t), "quiz_id")


@query(SCORES + "SELECT quiz_id, correct, total FROM scores")
def quiz_scores(t):
    return op.quiz_scores(answers(t), ["quiz_id"])


@query(SCORES + """
SELECT learner_id, sum(correct)::BIGINT AS correct, sum(total)::BIGINT AS total,
       round(100.0 * sum(correct) / sum(total), 4) AS accuracy
FROM taken GROUP BY learner_id
""")
def quiz_accuracy(t):
    return op.quiz_accuracy(_taken(t), "learner_id")


@query(SCORES + """
SELECT quiz_id, learner_id, ts, correct, total, position, correct::VARCHAR || '/' || total::VARCHAR AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY ts DESC, quiz_id DESC) AS position FROM taken
) WHERE position <= 3
""")
def quiz_history(t):
    return op.quiz_history(_taken(t), "learner_id", "quiz_id", "ts", 3)


@query("""
WITH marks AS (
  SELECT o_orderkey AS quiz_id, (o_custkey % 12)::VARCHAR || '/' || nullif(o_orderkey % 10, 0)::VARCHAR AS text FROM orders
)
SELECT quiz_id, TRY_CAST(split_part(text, '/', 1) AS BIGINT) AS correct,
       TRY_CAST(split_part(text, '/', 2) AS BIGINT) AS total
FROM marks
""")
def parse_score(t):
    from scholium.functions.columns import parse_score as parse

    text = F.concat(
        (F.col("o_custkey") % 12).cast("string"),
        F.lit("/"),
        F.nullif(F.col("o_orderkey") % 10, F.lit(0)).cast("string"),
    )
    return t("orders").select(F.col("o_orderkey").alias("quiz_id"), parse(text).alias("s")).select("quiz_id", "s.*")


@query("""
WITH placed AS (
  SELECT l_orderkey AS quiz_id, l_linenumber::BIGINT AS question_no, l_partkey AS item_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS question,
         count(*) OVER (PARTITION BY l_orderkey) AS completed
  FROM lineitem
), sized AS (
  SELECT p.*, 20 + o_custkey % 5 AS size FROM placed p LEFT JOIN orders ON o_orderkey = quiz_id
)
SELECT *, 'Question ' || question::VARCHAR || ' / ' || size::VARCHAR AS question_label,
       'Completed ' || completed::VARCHAR || ' / ' || size::VARCHAR AS completed_label
FROM sized
""")
def quiz_progress(t):
    sizes = t("orders").select(F.col("o_orderkey").alias("quiz_id"), (20 + F.col("o_custkey") % 5).alias("size"))
    given = answers(t).drop("correct")
    return op.quiz_progress(given, sizes, "quiz_id", [F.col("question_no"), F.col("item_id")])


@query("""
WITH marked AS (
  SELECT l_orderkey AS attempt, coalesce(nullif(l_returnflag, 'N') = CASE WHEN p_size < 25 THEN 'A' ELSE 'R' END, false) AS ok
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey
), scored AS (SELECT attempt, count(*) FILTER (ok) AS correct, count(*) AS total FROM marked GROUP BY attempt)
SELECT attempt, correct, total, correct::VARCHAR || '/' || total::VARCHAR AS score,
       round(100.0 * correct / total, 4) AS accuracy
FROM scored
""")
def grade(t):
    given = t("lineitem").select(
        F.col("l_orderkey").alias("attempt"),
        F.col("l_partkey").alias("question"),
        F.nullif("l_returnflag", F.lit("N")).alias("answer"),
    )
    key = t("part").select(
        F.col("p_partkey").alias("question"), F.when(F.col("p_size") < 25, "A").otherwise("R").alias("solution")
    )
    return op.grade(given, key, "attempt", "question")


@query("""
WITH hours AS (
  SELECT user_id, date_trunc('week', ts)::DATE AS week, round(sum(value) / 60, 4) AS hours
  FROM events WHERE event_type <> 'purchase' GROUP BY ALL
), quizzes AS (
  SELECT user_id, date_trunc('week', ts)::DATE AS week, count(*) AS quizzes, count(*) FILTER (value >= 15) AS correct
  FROM events WHERE event_type = 'purchase' GROUP BY ALL
)
SELECT coalesce(h.user_id, q.user_id) AS learner_id, coalesce(h.week, q.week) AS week, coalesce(hours, 0) AS hours,
       coalesce(quizzes, 0)::BIGINT AS quizzes, round(100.0 * correct / quizzes, 4) AS accuracy
FROM hours h FULL JOIN quizzes q ON q.user_id = h.user_id AND q.week = h.week
""")
def weekly_report(t):
    rows = activity(t)
    studied = rows.where(F.col("kind") != "purchase")
    marked = rows.where(F.col("kind") == "purchase").withColumn("correct", F.col("minutes") >= 15)
    return op.weekly_report(studied, marked, "learner_id", "ts", "minutes")


@query("""
WITH weekly AS (
  SELECT l_suppkey AS learner_id, date_trunc('week', l_shipdate)::DATE AS period,
         count(*) FILTER (l_returnflag = 'A') AS correct, count(*) AS total
  FROM lineitem GROUP BY ALL
), rated AS (SELECT *, round(100.0 * correct / total, 4) AS accuracy FROM weekly),
lagged AS (
  SELECT *, CASE WHEN lag(period) OVER w = period - 7 THEN lag(accuracy) OVER w END AS previous
  FROM rated WINDOW w AS (PARTITION BY learner_id ORDER BY period)
)
SELECT *, round(accuracy - previous, 4) AS change_points FROM lagged
""")
def accuracy_change(t):
    answers = t("lineitem").select(
        F.col("l_suppkey").alias("learner_id"), F.col("l_shipdate").alias("ts"), (F.col("l_returnflag") == "A").alias("correct")
    )
    return op.accuracy_change(answers, "learner_id", "ts")
