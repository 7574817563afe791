"""Goals, badges, leaderboards and ranks."""

from __future__ import annotations

from collections.abc import Sequence

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholium.functions.columns import clamp_pct, medal, percent, rank_label


def goal_attainment(done: DataFrame, goals: DataFrame, key: str) -> DataFrame:
    """Share of a target reached, in whole percent within 0..100; no work yet counts as 0.

    ``done`` has one ``done`` per key, ``goals`` one ``target``.
    """
    joined = goals.select(key, "target").join(done.select(key, "done"), key, "left")
    reached = F.coalesce("done", F.lit(0.0))
    return joined.select(
        key,
        "target",
        reached.alias("done"),
        clamp_pct(percent(reached, "target", 0)).alias("pct"),
        F.coalesce(reached >= F.col("target"), F.lit(False)).alias("met"),
    )


def goals_met(sub_goals: DataFrame, key: str) -> DataFrame:
    """``n/m done`` over the parts of a goal (rows with ``done`` and ``target``)."""
    counted = sub_goals.groupBy(key).agg(
        F.count_if(F.col("done") >= F.col("target")).alias("met"), F.count("*").alias("parts")
    )
    label = F.concat(F.col("met").cast("string"), F.lit("/"), F.col("parts").cast("string"), F.lit(" done"))
    return counted.withColumn("label", label).withColumn("pct", percent("met", "parts", 0))


def award_badges(
    metrics: DataFrame, key: str, rules: Sequence[tuple[str, str, float]]
) -> DataFrame:
    """Badges (name, metric column, threshold) whose threshold a learner reaches.

    The rules are a short list in the code, so they become one projection and no join.
    """
    earned = F.array_compact(
        F.array(*[F.when(F.col(metric) >= threshold, F.lit(name)) for name, metric, threshold in rules])
    )
    return metrics.select(
        key,
        F.array_join(earned, ", ").alias("badges"),
        F.size(earned).cast("bigint").alias("n_badges"),
    )


def points_total(df: DataFrame, key: str, points: str) -> DataFrame:
    """Points per learner to two decimals; text points are read as numbers."""
    number = F.col(points).try_cast("double")
    return df.groupBy(key).agg(F.round(F.sum(number), 2).alias("points"))


def leaderboard(df: DataFrame, key: str, points: str, k: int) -> DataFrame:
    """Best ``k`` learners with rank (gaps after ties), label and medal; ties at place k all stay.

    Ranks come from a ladder of the distinct totals at or above the k-th place, at most ``k``
    rows, so the only window without keys never sees more than that.
    """
    totals = points_total(df, key, points).where(F.col("points").isNotNull())
    last_place = totals.orderBy(F.col("points").desc()).limit(k).agg(F.min("points"))
    best = totals.where(F.col("points") >= last_place.scalar())
    higher = Window.orderBy(F.col("points").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ladder = (
        best.groupBy("points")
        .agg(F.count("*").alias("_n"))
        .select("points", (F.coalesce(F.sum("_n").over(higher), F.lit(0)) + 1).alias("rank"))
    )
    return (
        best.join(F.broadcast(ladder), "points")
        .select(key, "points", "rank", rank_label("rank").alias("rank_label"), medal("rank").alias("medal"))
        .orderBy("rank", key)
    )


def own_rank(df: DataFrame, key: str, points: str, learner: Any) -> DataFrame:
    """Rank of one learner: one more than the number of learners with more points."""
    totals = points_total(df, key, points)
    mine = totals.where(F.col(key) == learner)
    return (
        totals.agg(
            F.count_if(F.col("points") > mine.select("points").scalar()).alias("_above"),
            F.max(F.when(F.col(key) == learner, F.col("points"))).alias("points"),
            F.count("*").alias("learners"),
        )
        .where(F.col("points").isNotNull())
        .select(
            F.lit(learner).cast(df.schema[key].dataType).alias(key),
            "points",
            (F.col("_above") + 1).alias("rank"),
            rank_label(F.col("_above") + 1).alias("rank_label"),
            "learners",
        )
    )
