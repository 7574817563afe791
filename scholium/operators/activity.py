"""Study activity: counts, time, series, streaks, sessions and changes between periods.

Activity tables are reduced to one row per (learner, day), (learner, week) or similar before any
window runs, so the windows see rows bounded by the calendar however busy one learner is.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholium.functions.columns import percent
from scholium.functions.times import at, day_of, format_hm, format_hours, moment, on, period_start, week_of
from scholium.plans import top_per_key

When = datetime | date | str


def activity_counts(df: DataFrame, key: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """Rows per learner and kind, one column per kind."""
    return df.groupBy(key).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def study_time(df: DataFrame, key: str, measure: str) -> DataFrame:
    """Total minutes per learner, with both text forms."""
    total = df.groupBy(key).agg(F.round(F.sum(measure), 2).alias("minutes"))
    return total.select(
        key, "minutes", format_hm("minutes").alias("time_hm"), format_hours("minutes").alias("time_hours")
    )


def in_period(df: DataFrame, ts: str, period: str, as_of: When) -> DataFrame:
    """Rows of the current day, week or month before ``as_of``."""
    return df.where((F.col(ts) >= at(period_start(period, as_of))) & (F.col(ts) < at(as_of)))


def period_change(
    df: DataFrame, key: str, ts: str, measure: str, unit: str = "week", as_of: When | None = None
) -> DataFrame:
    """Total per learner and period and its change in percent against the period before.

    Idle periods after a learner's first one count as zero, up to the period of ``as_of`` when
    given (else up to the learner's last); rows count that lie before ``as_of``. The change is null when the period before is zero.
    """
    if unit not in ("day", "week"):
        raise ValueError("unit must be day or week")
    step = 7 if unit == "week" else 1
    start = week_of if unit == "week" else day_of
    if as_of is not None:
        df = df.where(F.col(ts) < at(as_of))
    totals = df.groupBy(key, start(ts).alias("period")).agg(F.round(F.sum(measure), 2).alias("total"))
    by_time = Window.partitionBy(key).orderBy("period")
    last = F.col("period") if as_of is None else start(at(as_of))
    until = F.coalesce(F.date_sub(F.lead("period").over(by_time), step), last)
    # Each row stands for its own period and for the idle ones that follow it.
    periods = F.transform(
        F.sequence(F.lit(0), F.floor(F.date_diff("_until", "period") / step).cast("int")),
        lambda i: F.date_add("period", i * step),
    )
    filled = (
        totals.withColumn("_until", until)
        .select(key, "total", F.posexplode(periods).alias("_i", "_period"))
        .select(key, F.col("_period").alias("period"), F.when(F.col("_i") == 0, F.col("total")).otherwise(0.0).alias("total"))
    )
    previous = F.lag("total").over(by_time)
    return filled.withColumn("previous", previous).select(
        key,
        "period",
        "total",
        "previous",
        percent(F.col("total") - F.col("previous"), "previous").alias("change_pct"),
    )


def daily_series(
    df: DataFrame,
    key: str,
    ts: str,
    measure: str,
    start: When,
    end: When,
    learners: DataFrame | None = None,
) -> DataFrame:
    """One row per learner and day in [start, end), zero where idle.

    Covers the learners active in the range, and all of ``learners`` when that is given.
    """
    first, stop = moment(start), moment(end)
    daily = (
        df.where((F.col(ts) >= at(first)) & (F.col(ts) < at(stop)))
        .groupBy(key, day_of(ts).alias("day"))
        .agg(F.sum(measure).alias("total"))
    )
    if learners is not None:
        idle = learners.select(
            key, F.lit(None).cast("date").alias("day"), F.lit(None).cast("double").alias("total")
        )
        daily = daily.unionByName(idle)
    # At most one entry per day of the range.
    entry = F.when(F.col("day").isNotNull(), F.struct("day", "total"))
    by_key = daily.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("_totals"))
    days = F.sequence(on(first), on(stop - timedelta(microseconds=1)))
    return by_key.select(key, "_totals", F.explode(days).alias("day")).select(
        key, "day", F.round(F.coalesce(F.try_element_at("_totals", F.col("day")), F.lit(0.0)), 2).alias("total")
    )


def weekday_profile(df: DataFrame, ts: str, measure: str) -> DataFrame:
    """Total per weekday, Monday first."""
    day = day_of(ts)
    return (
        df.groupBy(F.weekday(day).cast("bigint").alias("weekday"), F.date_format(day, "E").alias("label"))
        .agg(F.round(F.sum(measure), 2).alias("total"), F.count("*").alias("n"))
        .orderBy("weekday")
    )


def active_days(df: DataFrame, key: str, ts: str) -> DataFrame:
    return df.select(key, day_of(ts).alias("day")).distinct()


def streak_runs(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Runs of consecutive active days per learner."""
    by_day = Window.partitionBy(key).orderBy("day")
    anchored = active_days(df, key, ts).withColumn("_anchor", F.date_sub("day", F.row_number().over(by_day)))
    return anchored.groupBy(key, "_anchor").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days")
    ).drop("_anchor")


def study_streak(df: DataFrame, key: str, ts: str, as_of: When) -> DataFrame:
    """Longest run, and the run that reaches ``as_of`` or the day before (else 0)."""
    runs = streak_runs(df.where(F.col(ts) <= at(as_of)), key, ts)
    alive = F.col("last_day") >= F.date_sub(on(as_of), 1)
    return runs.groupBy(key).agg(
        F.max(F.when(alive, F.col("days")).otherwise(0)).alias("current_streak"),
        F.max("days").alias("longest_streak"),
    )


def recent_activity(df: DataFrame, key: str, ts: str, tie: str, k: int) -> DataFrame:
    """Latest ``k`` rows per learner."""
    return top_per_key(df, [key], [F.col(ts).desc(), F.col(tie).desc()], k)


def consistency_change(df: DataFrame, key: str, ts: str, as_of: When, days: int = 7) -> DataFrame:
    """Share of active days in the last ``days`` days against the same number before them."""
    end = moment(as_of).replace(hour=0, minute=0, second=0, microsecond=0)
    middle, start = end - timedelta(days=days), end - timedelta(days=2 * days)
    seen = active_days(df.where((F.col(ts) >= at(start)) & (F.col(ts) < at(end))), key, ts)
    counted = seen.groupBy(key).agg(
        F.count_if(F.col("day") >= on(middle)).alias("active_days"),
        F.count_if(F.col("day") < on(middle)).alias("active_days_before"),
    )
    share = lambda c: percent(c, F.lit(days))
    return counted.select(
        key,
        "active_days",
        "active_days_before",
        share("active_days").alias("consistency_pct"),
        share("active_days_before").alias("consistency_before_pct"),
        percent(F.col("active_days") - F.col("active_days_before"), F.lit(days)).alias("change_points"),
    )


def new_concepts(df: DataFrame, key: str, subject: str, ts: str, day: When) -> DataFrame:
    """Subjects each learner met for the first time on ``day``."""
    before = moment(day) + timedelta(days=1)
    first = (
        df.where(F.col(ts) < at(before)).groupBy(key, subject).agg(F.min(ts).alias("_first"))
    )
    return (
        first.where(F.col("_first") >= at(moment(day)))
        .groupBy(key)
        .agg(F.count("*").alias("new_concepts"))
    )


def focus_sessions(df: DataFrame, key: str, ts: str, measure: str, gap: timedelta) -> DataFrame:
    """Sessions that end after a silence longer than ``gap``.

    Rows are first merged per learner and time cell one gap wide: two rows of a cell are never
    further apart than the gap, so no session boundary lies inside it. What is left per
    learner is bounded by the calendar, and the merge happens before the shuffle.
    """
    width = int(gap.total_seconds() * 1_000_000)
    # Counted without a zone, as silence is: a change of clocks would shift the cells.
    since = F.col(ts).cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    instant = F.extract(F.lit("DAY"), since).cast("bigint") * 86_400_000_000 + (
        (F.extract(F.lit("HOUR"), since) * 3600 + F.extract(F.lit("MINUTE"), since) * 60).cast("bigint") * 1_000_000
        + (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("bigint")
    )
    cells = (
        df.groupBy(key, F.floor(instant / width).alias("_cell"))
        .agg(
            F.min(ts).alias("_first"),
            F.max(ts).alias("_last"),
            F.count("*").alias("_n"),
            F.sum(measure).alias("_measure"),
        )
    )
    by_time = Window.partitionBy(key).orderBy("_cell")
    silence = F.col("_first") - F.lag("_last").over(by_time)
    starts = F.coalesce((silence > F.lit(gap)).cast("int"), F.lit(1))
    return (
        cells.withColumn("_starts", starts)
        .withColumn("_session", F.sum("_starts").over(by_time))
        .groupBy(key, "_session")
        .agg(
            F.min("_first").alias("session_start"),
            F.max("_last").alias("last_activity"),
            F.sum("_n").alias("n"),
            F.round(F.sum("_measure"), 2).alias("minutes"),
        )
        .drop("_session")
    )


def focus_time_per_day(sessions: DataFrame, key: str) -> DataFrame:
    """Sessions and minutes per learner and day of the session's start."""
    return sessions.groupBy(key, day_of("session_start").alias("day")).agg(
        F.count("*").alias("sessions"), F.round(F.sum("minutes"), 2).alias("minutes")
    )
