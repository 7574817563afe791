"""Column functions on small fixed values."""

from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from scholium.functions import columns as c
from scholium.functions import text, times
from scholium.operators.feeds import task_status


def values(spark, rows, schema, column):
    return [row[0] for row in spark.createDataFrame(rows, schema).select(column).collect()]


def test_initials(spark):
    names = [("Riya Patel",), ("Noah Kim",), ("Aisha Rahman",), ("A  B",), (None,), ("",), ("one two three",)]
    assert values(spark, names, "n string", c.initials("n")) == ["RP", "NK", "AR", "A", "S", "", "OT"]


def test_clamp(spark):
    numbers = [(-5.0,), (150.0,), (None,), (float("nan"),), (42.5,)]
    assert values(spark, numbers, "v double", c.clamp_pct("v")) == [0.0, 100.0, 0.0, None, 42.5]


def test_capped_count(spark):
    assert values(spark, [(10,), (9,), (0,), (-1,), (None,)], "n int", c.capped_count("n")) == ["9+", "9", None, None, None]


def test_default_and_presence(spark):
    rows = [("", "x"), (None, "x"), (" ", "x"), ("a", "")]
    assert values(spark, rows, "a string, b string", c.default_if_blank("a", "d")) == ["d", "d", " ", "a"]
    assert values(spark, rows, "a string, b string", c.present("a", "b")) == [False, False, True, False]


def test_first_or(spark):
    rows = [(["a", "b"],), ([],), ([""],), (None,), ([None],)]
    assert values(spark, rows, "v array<string>", c.first_or("v", "d")) == ["a", "d", "d", "d", "d"]


def test_labels(spark):
    rows = [(9, 10), (None, 10)]
    assert values(spark, rows, "a int, b int", c.score_label("a", "b")) == ["9/10", None]
    assert values(spark, rows, "a int, b int", c.rank_label("a")) == ["#9", None]
    assert values(spark, rows, "a int, b int", c.flag("a", 9)) == [True, False]
    assert values(spark, [(1,), (3,), (4,)], "r bigint", c.medal("r")) == ["🥇", "🥉", "⭐"]
    cases = [(F.col("r") > 2, "many"), (F.col("r") > 0, "some")]
    assert values(spark, [(3,), (1,), (0,)], "r int", c.case_label(cases, "none")) == ["many", "some", "none"]


def test_scores(spark):
    rows = [("9/10",), (" 8 / 10 ",), ("x/10",), ("7",), (None,)]
    parsed = values(spark, rows, "s string", c.parse_score("s"))
    assert parsed == [Row(9, 10), Row(8, 10), Row(None, 10), Row(7, None), Row(None, None)]
    total = spark.createDataFrame(rows[:2], "s string").select(c.parse_score("s").alias("p"))
    summed = total.agg(F.sum("p.correct").alias("c"), F.sum("p.total").alias("t"))
    assert summed.select("c", "t", c.percent("c", "t")).first()[:] == (17, 20, 85.0)


def test_compact_number(spark):
    rows = [(950,), (20_000,), (100_999,), (1_000_000,), (3_400_000_000,)]
    assert values(spark, rows, "n bigint", c.compact_number("n")) == ["950", "20K+", "100K+", "1M+", "3B+"]


def test_durations(spark):
    minutes = [(18 * 60 + 42.0,), (250.9,), (870.0,), (7200.0,), (5.0,)]
    assert values(spark, minutes, "m double", times.format_hm("m")) == ["18h 42m", "4h 10m", "14h 30m", "120h 00m", "0h 05m"]
    assert values(spark, minutes, "m double", times.format_hours("m")) == ["18.7h", "4.2h", "14.5h", "120.0h", "0.1h"]


def test_relative_time(spark):
    now = "2024-05-20 15:00:00"
    stamps = [
        ("2024-05-20 14:59:30", "Just now"),
        ("2024-05-20 14:59:00", "1 minute ago"),
        ("2024-05-20 14:50:00", "10 minutes ago"),
        ("2024-05-20 14:00:00", "1 hour ago"),
        ("2024-05-20 04:00:00", "11 hours ago"),
        ("2024-05-20 02:00:00", "Today"),
        ("2024-05-19 23:00:00", "Yesterday"),
        ("2024-05-18 01:00:00", "2 days ago"),
        ("2024-05-20 15:00:01", None),
    ]
    rows = [(datetime.fromisoformat(s),) for s, _ in stamps]
    assert values(spark, rows, "t timestamp_ntz", times.relative_time("t", now)) == [label for _, label in stamps]


def test_due_label(spark):
    rows = [(datetime(2024, 5, 20, 17),), (datetime(2024, 5, 21, 9),), (datetime(2024, 5, 24, 16),)]
    labels = values(spark, rows, "t timestamp_ntz", times.due_label("t", "2024-05-20 08:00:00"))
    assert labels == ["Today, 5:00 PM", "Tomorrow, 9:00 AM", "May 24, 4:00 PM"]


def test_task_status(spark):
    rows = [(True, datetime(2024, 5, 20, 10)), (False, datetime(2024, 5, 20, 14)), (False, datetime(2024, 5, 20, 18))]
    status = task_status(F.col("done"), F.col("due"), "2024-05-20 15:00:00")
    assert values(spark, rows, "done boolean, due timestamp_ntz", status) == ["Completed", "Pending", "Upcoming"]


def test_periods():
    assert times.period_start("today", "2024-05-22 10:00:00") == datetime(2024, 5, 22)
    assert times.period_start("week", "2024-05-22 10:00:00") == datetime(2024, 5, 20)
    assert times.period_start("month", "2024-05-22 10:00:00") == datetime(2024, 5, 1)
    with pytest.raises(ValueError):
        times.period_start("year", "2024-05-22")


def test_trim_covers_all_white_space(spark):
    rows = [("\t a b \n",), ("﻿ x",), (" 　 ",)]
    assert values(spark, rows, "t string", text.trim_all("t")) == ["a b", "x", ""]


def test_contains_text(spark):
    rows = [("Graph Theory",), ("trees",)]
    assert values(spark, rows, "t string", text.contains_text("t", " gRaPh ")) == [True, False]
    assert values(spark, rows, "t string", text.contains_text("t", "  ")) == [True, True]


def test_plain_text(spark):
    html = (
        "<html><head><title>A &amp; B</title><style>p{}</style></head><body><nav>menu</nav>"
        "<script>if (a < b) x('</p>')</script><p>One&nbsp;two</p><!-- <p>no</p> -->&amp;lt;</body></html>"
    )
    assert values(spark, [(html,)], "h string", text.plain_text("h")) == ["One two &lt;"]
    assert values(spark, [(html,)], "h string", text.page_title("h")) == ["A & B"]


def test_sentences_and_words(spark):
    rows = [("One two. Three!  Four?\n\n Five",), ("v1.2 stays",), ("  ",)]
    assert values(spark, rows, "t string", text.sentences("t")) == [
        ["One two", "Three", "Four", "Five"],
        ["v1.2 stays"],
        [],
    ]
    assert values(spark, [("Été d'été, 3x",)], "t string", text.words("t")) == [["été", "d", "été", "x"]]


def test_blank_out_hits_whole_words_only(spark):
    rows = [("Été été étés, ÉTÉ.", "été")]
    assert values(spark, rows, "s string, w string", text.blank_out("s", "w")) == ["____ ____ étés, ____."]
