"""Notifications, tasks, calendar, sharing and platform figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions.columns import capped_count, compact_number
from scholium.functions.times import at, day_of, due_label, on, period_start
from scholium.operators.activity import When
from scholium.plans import top_per_key


def notification_feed(df: DataFrame, key: str, ts: str, tie: str, read: str, k: int) -> DataFrame:
    """Newest ``k`` notifications per learner, with the unread count over all of theirs."""
    unread = df.groupBy(key).agg(F.count_if(~F.col(read)).alias("unread"))
    newest = top_per_key(df, [key], [F.col(ts).desc(), F.col(tie).desc()], k)
    return newest.join(unread, key).withColumn("badge", capped_count("unread"))


def upcoming_tasks(df: DataFrame, key: str, due: str, tie: str, as_of: When, k: int) -> DataFrame:
    """Next ``k`` tasks per learner from ``as_of`` on, with the text of the due time."""
    ahead = df.where(F.col(due) >= at(as_of))
    return top_per_key(ahead, [key], [F.col(due), F.col(tie)], k).withColumn("due_label", due_label(due, as_of))


def task_status(done: Column, due: Column, as_of: When) -> Column:
    """Completed, else Pending once due, else Upcoming."""
    return F.when(done, F.lit("Completed")).when(due <= at(as_of), F.lit("Pending")).otherwise(F.lit("Upcoming"))


def week_grid(tasks: DataFrame, due: str, as_of: When) -> DataFrame:
    """The seven days of the week of ``as_of`` with the number of tasks due, today flagged."""
    monday = period_start("week", as_of)
    due_by_day = (
        tasks.where((F.col(due) >= at(monday)) & (F.col(due) < at(monday + timedelta(days=7))))
        .groupBy(day_of(due).alias("day"))
        .agg(F.count("*").alias("_n"))
    )
    days = tasks.sparkSession.range(7).select(F.date_add(on(monday), F.col("id").cast("int")).alias("day"))
    return (
        days.join(due_by_day, "day", "left")
        .select(
            "day",
            F.date_format("day", "E").alias("label"),
            F.col("day").eqNullSafe(on(as_of)).alias("is_today"),
            F.coalesce("_n", F.lit(0)).cast("bigint").alias("tasks"),
        )
        .orderBy("day")
    )


def visible_only(df: DataFrame, learners: DataFrame, key: str, visible: str = "visible") -> DataFrame:
    """Rows of the learners who share their data."""
    return df.join(learners.where(F.coalesce(visible, F.lit(False))).select(key), key, "left_semi")


def mask_hidden(
    df: DataFrame, learners: DataFrame, key: str, name: str = "name", visible: str = "visible", mask: str = "Student"
) -> DataFrame:
    """All rows, with the name of a learner who does not share replaced."""
    shown = learners.select(key, F.when(F.col(visible), F.col(name)).alias(name))
    return df.join(shown, key, "left").withColumn(name, F.coalesce(name, F.lit(mask)))


def with_learner_name(df: DataFrame, learners: DataFrame, key: str, name: str = "name") -> DataFrame:
    """Names on a ranking or feed. Join after reducing to what is shown, not before."""
    return df.join(learners.select(key, name), key)


# Error of about 0.8 %; counts up to some two thousand are nearly exact.
SKETCH_BITS = 14


def distinct_per_day(df: DataFrame, ts: str, column: str, by: Sequence[str] = (), bits: int = SKETCH_BITS) -> DataFrame:
    """A sketch of the distinct values per day (and group), of at most 2^bits bytes whatever their number.

    Sketches of days can be kept and united: a period then needs no scan of the rows.
    """
    return df.groupBy(*by, F.col(ts).cast("date").alias("day")).agg(F.hll_sketch_agg(column, F.lit(bits)).alias("sketch"))


def distinct_in_period(sketches: DataFrame, start: str | None = None, end: str | None = None, by: Sequence[Column | str] = ()) -> DataFrame:
    """Estimated number of distinct values in the days from ``start`` up to before ``end``, per group of ``by``."""
    return _in_days(sketches, start, end).groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def members_per_day(df: DataFrame, ts: str, column: str, by: Sequence[str] = ()) -> DataFrame:
    """The distinct values of ``column`` per day (and group), one row each.

    The exact counterpart of ``distinct_per_day``: days can be kept and united too, at the cost of a row per value and day.
    """
    return df.select(*by, F.col(ts).cast("date").alias("day"), column).distinct()


def members_in_period(
    members: DataFrame, column: str, start: str | None = None, end: str | None = None, by: Sequence[Column | str] = ()
) -> DataFrame:
    """Exact number of distinct values in the days from ``start`` up to before ``end``, per group of ``by``."""
    return _in_days(members, start, end).groupBy(*by).agg(F.countDistinct(column).alias("n"))


def _in_days(days: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start is not None:
        days = days.where(F.col("day") >= F.lit(start).cast("date"))
    return days if end is None else days.where(F.col("day") < F.lit(end).cast("date"))


def platform_stats(counts: Mapping[str, DataFrame], satisfaction: DataFrame, satisfied: str) -> DataFrame:
    """Headline figures, one row each: distinct entities per one-column table, and the satisfied share."""
    parts = [
        table.agg(F.countDistinct(*table.columns).alias("n")).select(
            F.lit(name).alias("figure"), F.col("n").cast("double").alias("value"), compact_number("n").alias("label")
        )
        for name, table in counts.items()
    ]
    rate = satisfaction.agg(
        F.round(F.try_divide(100.0 * F.count_if(F.col(satisfied)), F.count("*").cast("double")), 0).alias("value")
    )
    parts.append(
        rate.select(
            F.lit("satisfaction").alias("figure"),
            "value",
            F.concat(F.col("value").cast("bigint").cast("string"), F.lit("%")).alias("label"),
        )
    )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
