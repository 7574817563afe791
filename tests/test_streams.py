"""Streams over several files: late rows, repeats, order of arrival, restarts."""

import os
import random
import time
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scholium.sources import KeyedTable, event_stream, parquet_stream
from scholium.streaming import feeds, sinks

SCHEMA = "event_id bigint, ts timestamp_ntz, learner bigint, minutes double"


@pytest.fixture
def inbox(spark, tmp_path):
    """Writes batches of rows as files that are read one per trigger, in the order written."""
    folder = tmp_path / "inbox"
    folder.mkdir()

    def put(*batches):
        for rows in batches:
            n = len(list(folder.glob("*.parquet")))
            frame = spark.createDataFrame(rows, SCHEMA).toPandas()
            target = folder / f"{n:03}.parquet"
            frame.to_parquet(target, coerce_timestamps="us")
            os.utime(target, (time.time() - 1000 + n, time.time() - 1000 + n))
        return event_stream(spark, str(folder), files_per_trigger=1)

    return put


def day(d, hour=12):
    return datetime(2024, 5, d, hour)


def test_daily_totals_take_updates_and_drop_late_rows(spark, inbox, tmp_path):
    target, table = str(tmp_path / "out"), KeyedTable(spark, str(tmp_path / "table"), ["learner", "day"], buckets=4)
    stream = inbox(
        [(1, day(1), 1, 5.0)],
        [(2, day(1, 20), 1, 2.0), (3, day(4), 1, 1.0)],
        [(4, day(5), 2, 1.0)],
        [(5, day(1), 1, 100.0)],  # the watermark is past this day
    )
    totals = feeds.daily_activity(stream, "learner", "ts", "minutes", "1 day")
    sinks.upsert_table(totals, table, target).awaitTermination()
    got = table.read().orderBy("learner", "day").collect()
    assert [tuple(r) for r in got] == [
        (1, date(2024, 5, 1), 7.0, 2),
        (1, date(2024, 5, 4), 1.0, 1),
        (2, date(2024, 5, 5), 1.0, 1),
    ]
    # A restart goes on from the checkpoint.
    stream = inbox([(6, day(5), 2, 4.0)])
    totals = feeds.daily_activity(stream, "learner", "ts", "minutes", "1 day")
    sinks.upsert_table(totals, table, target).awaitTermination()
    assert table.read().where("learner = 2").first().total == 5.0
    assert table.read().count() == 3


def test_dedup_drops_repeats_across_batches(inbox):
    stream = inbox([(1, day(1), 1, 1.0), (1, day(1), 1, 1.0)], [(1, day(1, 13), 1, 1.0), (2, day(1, 14), 1, 1.0)])
    got = sinks.run_to_end(feeds.dedup(stream, "ts", ["event_id"], "2 days"), "dedup")
    assert sorted(r.event_id for r in got.collect()) == [1, 2]


def test_sessions_close_with_the_watermark(inbox):
    start = day(1)
    first = [(i, start + timedelta(minutes=10 * i), 1, 1.0) for i in range(4)]
    later = [(9, start + timedelta(minutes=45), 1, 1.0), (10, day(3), 1, 1.0)]
    got = sinks.run_to_end(feeds.sessions(inbox(first, later), "learner", "ts", "minutes", "30 minutes", "1 hour"), "s")
    assert [(r.session_start, r.last_activity, r.n) for r in got.collect()] == [
        (start, start + timedelta(minutes=45), 5)
    ]


def test_milestones_do_not_depend_on_the_order_of_arrival(inbox):
    days = [3, 1, 2, 4, 6, 5, 7, 9, 8, 20]
    stream = inbox(*[[(d, day(d), 1, 1.0), (100 + d, day(d, 15), 1, 1.0)] for d in days])
    got = sinks.run_to_end(feeds.milestones(stream, "learner", "ts", [3, 7], "3 days"), "milestones").collect()
    assert sorted((r.day, r.streak) for r in got) == [(date(2024, 5, 3), 3), (date(2024, 5, 7), 7)]


def test_message_log(spark, tmp_path):
    source = str(tmp_path / "chat")
    spark.createDataFrame([(1, "  hi "), (2, " \t")], "turn int, text string").write.parquet(source)
    got = sinks.run_to_end(feeds.messages(parquet_stream(spark, source)), "chat").collect()
    assert [tuple(r) for r in got] == [(1, "hi")]


def test_stream_equals_batch(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    totals = feeds.daily_activity(event_stream(spark, path), "user_id", "ts", "value", "1 day")
    from scholium.plans import scratch_dir

    target = scratch_dir(spark, "totals")
    table = KeyedTable(spark, f"{target}/table", ["user_id", "day"])
    sinks.upsert_table(totals, table, f"{target}/state").awaitTermination()
    live = table.read()
    batch = (
        spark.read.parquet(path)
        .groupBy("user_id", F.col("ts").cast("date").alias("day"))
        .agg(F.round(F.sum("value"), 2).alias("total"), F.count("*").alias("n"))
    )
    assert live.exceptAll(batch).count() == 0 and batch.exceptAll(live).count() == 0


def test_settings_of_the_session_stay_as_they_were(spark, inbox, tmp_path):
    names = [
        "spark.sql.shuffle.partitions",
        "spark.sql.streaming.stateStore.providerClass",
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition",
    ]
    before = [spark.conf.get(n, None) for n in names]
    stream = feeds.sessions(inbox([(1, day(1), 7, 1.0)]), "learner", "ts", "minutes", "4 hours", "1 day")
    state = str(tmp_path / "state")
    sinks.append_parquet(stream, str(tmp_path / "rows"), state, partitions=3).awaitTermination()
    assert [spark.conf.get(n, None) for n in names] == before
    assert len([f for f in os.listdir(f"{state}/state/0") if f.isdigit()]) == 3


def islands(rows, lengths):
    """Milestones of a batch: (learner, day, length) for the runs of consecutive days that get that far."""
    out = []
    for learner in {r[2] for r in rows}:
        run, last = 0, None
        for d in sorted({r[1].date() for r in rows if r[2] == learner}):
            run = run + 1 if last is not None and d - last == timedelta(days=1) else 1
            last = d
            if run in lengths:
                out.append((learner, d, run))
    return sorted(out)


def test_milestones_in_any_order_of_files_are_those_of_a_batch(inbox):
    chance = random.Random(11)
    rows = [(i, day(1 + chance.randrange(24), chance.randrange(24)), chance.randrange(6), 1.0) for i in range(160)]
    # Days arrive up to eight days out of order, which is within the delay.
    ordered = sorted(rows, key=lambda r: (r[1] + timedelta(days=chance.randrange(8)), r[0]))
    parts = [ordered[i : i + 20] for i in range(0, len(ordered), 20)]
    closing = [[(900, day(1) + timedelta(days=50), 99, 1.0)]]
    got = sinks.run_to_end(feeds.milestones(inbox(*parts, *closing), "learner", "ts", [2, 3, 5], "9 days"), "milestones")
    assert sorted(map(tuple, got.collect())) == islands(rows, {2, 3, 5})


def test_broken_runs_leave_no_state(spark, inbox, tmp_path):
    """Learners 1 and 2 fall silent; once their next day is over, only learner 9's run is held."""
    state = str(tmp_path / "state")

    def held(*batches):
        stream = feeds.milestones(inbox(*batches), "learner", "ts", [2], "1 day")
        sinks.append_parquet(stream, str(tmp_path / "rows"), state, partitions=2).awaitTermination()
        reader = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "run")
        return sorted(r.key[0] for r in reader.load(state).select("key").collect())

    assert held([(i, day(1), i, 1.0) for i in (1, 2, 9)], [(4, day(3, 1), 9, 1.0)]) == [1, 2, 9]
    # Day 2 is closed when day 3 is over the delay: learners 1 and 2 were not active on it, nor was learner 9.
    assert held([(5, day(4, 1), 9, 1.0)]) == []
    assert held([(6, day(5, 1), 9, 1.0)]) == [9]
    assert held([(7, day(20), 8, 1.0)]) == []
    got = spark.read.schema("learner bigint, day date, streak bigint").parquet(str(tmp_path / "rows"))
    assert sorted(map(tuple, got.collect())) == [(9, date(2024, 5, 4), 2)]
