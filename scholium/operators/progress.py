"""Subject progress, quizzes and the weekly report."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholium.functions.columns import clamp_pct, percent, score_label
from scholium.functions.times import week_of
from scholium.plans import number_rows, salted_join, top_per_key


def subject_progress(df: DataFrame, key: str, subject: str, item: str, items: int) -> DataFrame:
    """Share of a subject's ``items`` a learner has done, counting each item once."""
    done = df.groupBy(key, subject).agg(F.countDistinct(item).alias("items_done"))
    return done.withColumn("progress", clamp_pct(percent("items_done", F.lit(items))))


def overall_progress(progress: DataFrame, key: str) -> DataFrame:
    """Unweighted mean over subjects, in whole percent."""
    return progress.groupBy(key).agg(
        F.round(F.avg("progress"), 0).alias("overall"), F.count("*").alias("subjects")
    )


def courses_completed(progress: DataFrame, key: str) -> DataFrame:
    return progress.groupBy(key).agg(F.count_if(F.col("progress") >= 100).alias("completed"))


def weak_topics(progress: DataFrame, key: str, subject: str, k: int) -> DataFrame:
    """The ``k`` subjects with the lowest progress per learner."""
    return top_per_key(progress, [key], [F.col("progress"), F.col(subject)], k)


def learning_pace(df: DataFrame, key: str, subject: str, item: str, ts: str, as_of: str, half_life: float = 14.0) -> DataFrame:
    """Items a learner newly does per day in a subject (``pace``), as a decayed rate.

    An item counts on the day it was first done, half as much with every ``half_life`` days that have passed since. For
    someone who does an item a day all along, the rate is one.
    """
    firsts = df.where(F.col(ts) < F.lit(as_of).cast("timestamp_ntz")).groupBy(key, subject, item).agg(F.min(ts).alias("_first"))
    age = F.date_diff(F.lit(as_of).cast("date"), F.col("_first").cast("date"))
    decayed = F.pow(F.lit(0.5), age / half_life)
    return firsts.groupBy(key, subject).agg((F.sum(decayed) * math.log(2) / half_life).alias("pace"))


def continue_learning(
    df: DataFrame, progress: DataFrame, key: str, subject: str, ts: str, tie: str, pace: DataFrame, items: int
) -> DataFrame:
    """The subject each learner touched last, with its progress and the days its open items take at the learner's pace.

    ``days_left`` is zero where none of the ``items`` is open and null where there is no pace to go by.
    """
    latest = df.groupBy(key).agg(
        F.max_by(F.struct(F.col(subject), F.col(ts)), F.struct(F.col(ts), F.col(tie))).alias("_last")
    )
    resumed = latest.select(key, F.col(f"_last.{subject}").alias(subject), F.col(f"_last.{ts}").alias("last_seen"))
    known = resumed.join(progress, [key, subject], "left").join(pace, [key, subject], "left")
    open_items = F.lit(items) - F.coalesce("items_done", F.lit(0))
    left = F.when(open_items <= 0, F.lit(0.0)).otherwise(F.try_divide(open_items.cast("double"), F.col("pace")))
    return known.withColumn("days_left", F.round(left, 2)).drop("pace")


def quiz_scores(answers: DataFrame, by: Sequence[str], correct: str = "correct") -> DataFrame:
    """Correct and answered questions per group; an unmarked answer is not correct."""
    return answers.groupBy(*by).agg(F.count_if(F.col(correct)).alias("correct"), F.count("*").alias("total"))


def quiz_accuracy(scores: DataFrame, key: str) -> DataFrame:
    """Correct of all answered questions, in percent (not the mean of quiz results)."""
    return (
        scores.groupBy(key)
        .agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))
        .withColumn("accuracy", percent("correct", "total"))
    )


def accuracy_change(answers: DataFrame, key: str, ts: str, correct: str = "correct") -> DataFrame:
    """Accuracy per learner and week, and its change in points against the week before.

    A week without answers has no row, and the week that follows it no change.
    """
    weekly = answers.groupBy(key, week_of(ts).alias("period")).agg(
        F.count_if(F.col(correct)).alias("correct"), F.count("*").alias("total")
    )
    weekly = weekly.withColumn("accuracy", percent("correct", "total"))
    before = F.lag(F.struct("period", "accuracy")).over(Window.partitionBy(key).orderBy("period"))
    previous = F.when(F.col("_before.period") == F.date_sub("period", 7), F.col("_before.accuracy"))
    return weekly.withColumn("_before", before).select(
        key,
        "period",
        "correct",
        "total",
        "accuracy",
        previous.alias("previous"),
        F.round(F.col("accuracy") - previous, 4).alias("change_points"),
    )


def quiz_history(scores: DataFrame, key: str, quiz: str, ts: str, k: int) -> DataFrame:
    """Last ``k`` quizzes per learner with their score text."""
    latest = top_per_key(scores, [key], [F.col(ts).desc(), F.col(quiz).desc()], k)
    return latest.withColumn("score", score_label("correct", "total"))


def quiz_progress(answers: DataFrame, sizes: DataFrame, quiz: str, order: Sequence[Column]) -> DataFrame:
    """``Question i / n`` for each answer of a quiz and ``Completed c / n`` for the quiz so far."""
    sized = number_rows(answers, order, [quiz], "question", "completed", lookup=sizes.select(quiz, "size"))
    label = lambda word, n: F.concat(
        F.lit(f"{word} "), F.col(n).cast("string"), F.lit(" / "), F.col("size").cast("string")
    )
    return sized.withColumn("question_label", label("Question", "question")).withColumn(
        "completed_label", label("Completed", "completed")
    )


def grade(
    answers: DataFrame,
    answer_key: DataFrame,
    attempt: str,
    question: str,
    answer: str = "answer",
    solution: str = "solution",
) -> DataFrame:
    """Score per attempt; a question without an answer is wrong.

    Equal answers of an attempt are counted before the join with the key, and a question that holds more than one
    task's share of them is spread over several.
    """
    counted = answers.groupBy(attempt, question, answer).agg(F.count("*").alias("_n"))
    marked = salted_join(counted, answer_key.select(question, solution), [question], [attempt, answer], "left")
    right = F.coalesce(F.col(answer) == F.col(solution), F.lit(False))
    return (
        marked.groupBy(attempt)
        .agg(F.sum(F.when(right, F.col("_n")).otherwise(0)).alias("correct"), F.sum("_n").alias("total"))
        .withColumn("score", score_label("correct", "total"))
        .withColumn("accuracy", percent("correct", "total"))
    )


def weekly_report(activity: DataFrame, answers: DataFrame, key: str, ts: str, measure: str) -> DataFrame:
    """Hours, quizzes and accuracy per learner and week; either side may be missing."""
    hours = activity.groupBy(key, week_of(ts).alias("week")).agg(F.round(F.sum(measure) / 60, 4).alias("hours"))
    quizzes = answers.groupBy(key, week_of(ts).alias("week")).agg(
        F.count("*").alias("quizzes"), F.count_if("correct").alias("correct")
    )
    return hours.join(quizzes, [key, "week"], "full").select(
        key,
        "week",
        F.coalesce("hours", F.lit(0.0)).alias("hours"),
        F.coalesce("quizzes", F.lit(0)).cast("bigint").alias("quizzes"),
        percent("correct", "quizzes").alias("accuracy"),
    )
