"""Periods, durations and the text forms of times. Every "now" is an argument."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholium.functions.columns import ColumnOrName, as_column

TIME_FORMAT = "h:mm a"
DAY_TIME_FORMAT = "MMM d, h:mm a"


def moment(value: datetime | date | str) -> datetime:
    """A zoneless datetime from a datetime, a date or ISO text."""
    if isinstance(value, str):
        return datetime.fromisoformat(value)
    if isinstance(value, datetime):
        return value
    return datetime(value.year, value.month, value.day)


def at(value: datetime | date | str) -> Column:
    """A zoneless timestamp literal; being a literal, it reaches the scan as a pushed filter."""
    return F.lit(moment(value).isoformat(sep=" ")).cast("timestamp_ntz")


def on(value: datetime | date | str) -> Column:
    return F.lit(moment(value).date())


def period_start(period: str, as_of: datetime | date | str) -> datetime:
    """Start of the day, Monday-based week or month that holds ``as_of``."""
    midnight = moment(as_of).replace(hour=0, minute=0, second=0, microsecond=0)
    if period == "today":
        return midnight
    if period == "week":
        return midnight - timedelta(days=midnight.weekday())
    if period == "month":
        return midnight.replace(day=1)
    raise ValueError(f"unknown period {period!r}: use today, week or month")


def day_of(ts: ColumnOrName) -> Column:
    return as_column(ts).cast("date")


def week_of(ts: ColumnOrName) -> Column:
    """Monday of the week."""
    return F.date_sub(day_of(ts), F.weekday(day_of(ts)))


def format_hm(minutes: ColumnOrName) -> Column:
    """``18h 42m``; part minutes are dropped."""
    whole = F.floor(as_column(minutes))
    return F.format_string("%dh %02dm", F.floor(whole / 60), F.pmod(whole, F.lit(60)))


def format_hours(minutes: ColumnOrName) -> Column:
    """``14.5h``: hours to one decimal, counted in whole hundredths of a minute, halves up."""
    hundredths = F.round(as_column(minutes) * 100).cast("bigint")
    tenths = F.floor((hundredths + 300) / 600)
    return F.format_string("%d.%dh", F.floor(tenths / 10), F.pmod(tenths, F.lit(10)))


def _counted(n: Column, unit: str) -> Column:
    noun = F.when(n == 1, F.lit(f" {unit} ago")).otherwise(F.lit(f" {unit}s ago"))
    return F.concat(n.cast("string"), noun)


def relative_time(ts: ColumnOrName, as_of: datetime | date | str) -> Column:
    """Age in words: minutes below an hour, hours up to twelve on the same day, then days.

    Times after ``as_of`` have no age and give null.
    """
    ts = as_column(ts)
    minutes = F.timestamp_diff("MINUTE", ts, at(as_of))
    days = F.date_diff(on(as_of), day_of(ts))
    hours = F.floor(minutes / 60)
    return (
        F.when(ts > at(as_of), F.lit(None))
        .when(minutes < 1, F.lit("Just now"))
        .when(minutes < 60, _counted(minutes, "minute"))
        .when((days == 0) & (hours < 12), _counted(hours, "hour"))
        .when(days == 0, F.lit("Today"))
        .when(days == 1, F.lit("Yesterday"))
        .otherwise(_counted(days, "day"))
    )


def due_label(due: ColumnOrName, as_of: datetime | date | str) -> Column:
    """``Today, 5:00 PM``, ``Tomorrow, 9:00 AM`` or ``May 24, 4:00 PM``."""
    due = as_column(due)
    days = F.date_diff(day_of(due), on(as_of))
    clock = F.date_format(due, TIME_FORMAT)
    return (
        F.when(days == 0, F.concat(F.lit("Today, "), clock))
        .when(days == 1, F.concat(F.lit("Tomorrow, "), clock))
        .otherwise(F.date_format(due, DAY_TIME_FORMAT))
    )
