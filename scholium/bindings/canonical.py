"""The study tables, as stand-ins over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.sources import Tables

KINDS = ["click", "error", "purchase", "signup", "view"]


def activity(t: Tables) -> DataFrame:
    return t("events").select(
        "event_id",
        "ts",
        F.col("user_id").alias("learner_id"),
        F.col("event_type").alias("kind"),
        F.get_json_object("props", "$.k").cast("int").alias("subject"),
        F.col("value").alias("minutes"),
    )


def learners(t: Tables) -> DataFrame:
    return t("customer").select(
        F.col("c_custkey").alias("learner_id"),
        F.col("c_name").alias("name"),
        (F.col("c_acctbal") >= 0).alias("visible"),
    )


def answers(t: Tables) -> DataFrame:
    """Marked answers of quizzes; the quiz is taken by the learner of its order."""
    return t("lineitem").select(
        F.col("l_orderkey").alias("quiz_id"),
        F.col("l_linenumber").cast("bigint").alias("question_no"),
        F.col("l_partkey").alias("item_id"),
        (F.col("l_returnflag") == "A").alias("correct"),
    )


def attempts(t: Tables) -> DataFrame:
    return t("orders").select(
        F.col("o_orderkey").alias("quiz_id"), F.col("o_custkey").alias("learner_id"), F.col("o_orderdate").alias("ts")
    )


def tasks(t: Tables) -> DataFrame:
    return t("orders").select(
        F.col("o_orderkey").alias("task_id"),
        F.col("o_custkey").alias("learner_id"),
        F.col("o_orderdate").alias("due_ts"),
        (F.col("o_orderstatus") == "F").alias("done"),
    )


def subject_areas(t: Tables) -> DataFrame:
    """Activity with subjects folded into ten areas, each with the five kinds as its items."""
    return activity(t).withColumn("area", (F.col("subject") % 10).cast("bigint"))
