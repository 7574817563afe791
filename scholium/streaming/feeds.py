"""Structured Streaming operators. Streams carry a zoned event time; rows later than the delay are dropped."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date, datetime, timedelta, timezone
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scholium.operators.rows import drop_blank


def daily_activity(stream: DataFrame, key: str, ts: str, measure: str, delay: str) -> DataFrame:
    """Running total per learner and day; write it in update mode."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(key, F.window(ts, "1 day"))
        .agg(F.round(F.sum(measure), 2).alias("total"), F.count("*").alias("n"))
        .select(key, F.col("window.start").cast("date").alias("day"), "total", "n")
    )


def dedup(stream: DataFrame, ts: str, ids: Sequence[str], delay: str) -> DataFrame:
    """The first arrival of each id; repeats within the delay are dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(ids))


def sessions(stream: DataFrame, key: str, ts: str, measure: str, gap: str, delay: str) -> DataFrame:
    """Sessions by silence longer than ``gap``, emitted once the watermark has passed their end.

    The sinks start it so that sessions of a partition are merged before the shuffle; a busy learner sends few rows.
    """
    return (
        stream.withWatermark(ts, delay)
        .groupBy(key, F.session_window(ts, gap))
        .agg(F.max(ts).alias("_last"), F.count("*").alias("n"), F.round(F.sum(measure), 2).alias("minutes"))
        .select(
            key,
            F.col("session_window.start").cast("timestamp_ntz").alias("session_start"),
            F.col("_last").cast("timestamp_ntz").alias("last_activity"),
            "n",
            "minutes",
        )
    )


# A run can go on until the day after its last one is over.
_RUN_ENDS_AFTER = timedelta(days=2)


def _start_of(day: date) -> datetime:
    return datetime(day.year, day.month, day.day, tzinfo=timezone.utc)


class StreakProcessor(StatefulProcessor):
    """Keeps a learner's last active day and the length of the run that ends there, for as long as the run can go on.

    A timer at the end of the day after the last one drops a run that was broken. Days arrive when the watermark closes
    them, and timers fire after the days of the same watermark, so no run is dropped that goes on.
    """

    def __init__(self, key: str, milestones: Sequence[int]):
        self.key = key
        self.milestones = frozenset(milestones)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "last_day date, length bigint")

    def _ends_at(self, last: date) -> int:
        return int((_start_of(last) + _RUN_ENDS_AFTER).timestamp() * 1000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        days = sorted({day for part in rows for day in part["day"]})
        known, length = self.run.get() if self.run.exists() else (None, 0)
        last, reached = known, []
        for day in days:
            if last is not None and day <= last:
                continue
            length = length + 1 if last is not None and (day - last).days == 1 else 1
            last = day
            if length in self.milestones:
                reached.append((key[0], day, length))
        if last != known:
            if known is not None:
                self.handle.deleteTimer(self._ends_at(known))
            self.run.update((last, length))
            self.handle.registerTimer(self._ends_at(last))
        yield pd.DataFrame(reached, columns=[self.key, "day", "streak"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.run.exists() and self._ends_at(self.run.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.run.clear()
        yield pd.DataFrame([], columns=[self.key, "day", "streak"])

    def close(self) -> None:
        pass


def milestones(stream: DataFrame, key: str, ts: str, lengths: Sequence[int], delay: str) -> DataFrame:
    """A row whenever a learner's run of active days reaches one of ``lengths``.

    Days come out of a windowed count only when the watermark has closed them, so they reach
    the state in order whatever the order of arrival, and as one row per learner and day. State is held for learners
    whose run can still go on: one whose last day and the day after it are over costs nothing.
    """
    days = (
        stream.withWatermark(ts, delay)
        .groupBy(key, F.window(ts, "1 day"))
        .agg(F.count("*").alias("n"))
        .select(key, F.window_time("window").alias("_time"), F.col("window.start").cast("date").alias("day"))
    )
    schema = T.StructType(
        [
            T.StructField(key, stream.schema[key].dataType),
            T.StructField("day", T.DateType()),
            T.StructField("streak", T.LongType()),
        ]
    )
    return days.groupBy(key).transformWithStateInPandas(
        statefulProcessor=StreakProcessor(key, lengths),
        outputStructType=schema,
        outputMode="Append",
        timeMode="EventTime",
    )


def messages(stream: DataFrame, text: str = "text") -> DataFrame:
    """The chat log: trimmed messages, blank ones dropped."""
    return drop_blank(stream, text)
