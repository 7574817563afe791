"""Metrics on small frames: fixed values, ties, gaps, missing rows and brute force."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from scholium.bindings import ORACLES, QUERIES
from scholium.operators import activity, feeds, goals, progress, rows
from tests import oracle


def stamps(spark, data):
    return spark.createDataFrame(data, "learner bigint, ts timestamp_ntz, minutes double")


def test_goal_attainment(spark):
    done = spark.createDataFrame([(1, 4.1), (2, 2.0), (3, 9.0)], "k int, done double")
    targets = spark.createDataFrame([(1, 5.0), (2, 3.0), (3, 5.0), (4, 5.0), (5, 0.0)], "k int, target double")
    got = {r.k: (r.pct, r.met) for r in goals.goal_attainment(done, targets, "k").collect()}
    assert got == {1: (82.0, False), 2: (67.0, False), 3: (100.0, True), 4: (0.0, False), 5: (0.0, True)}


def test_overall_progress(spark):
    subjects = [("Data Structures", 75), ("Database Systems", 60), ("Operating Systems", 80), ("Computer Networks", 56)]
    frame = spark.createDataFrame([(1, s, float(p)) for s, p in subjects], "k int, subject string, progress double")
    assert progress.overall_progress(frame, "k").first().overall == 68.0
    assert progress.courses_completed(frame, "k").first().completed == 0
    assert [r.subject for r in progress.weak_topics(frame, "k", "subject", 2).orderBy("position").collect()] == [
        "Computer Networks",
        "Database Systems",
    ]


def test_leaderboard_without_ties(spark):
    board = spark.createDataFrame([("Ananya", 1250), ("Marco", 1180), ("Lina", 1090)], "name string, points int")
    got = goals.leaderboard(board, "name", "points", 3).collect()
    assert [(r.name, r.rank_label, r.medal) for r in got] == [
        ("Ananya", "#1", "🥇"),
        ("Marco", "#2", "🥈"),
        ("Lina", "#3", "🥉"),
    ]


def test_leaderboard_orders_text_points_as_numbers(spark):
    points = [("Alex", "9800"), ("Student", "9200"), ("John", "8500"), ("Emma", "7900"), ("X", "12000"), ("Y", "none")]
    board = spark.createDataFrame(points, "name string, points string")
    got = goals.leaderboard(board, "name", "points", 5).collect()
    assert [(r.rank, r.name) for r in got] == [(1, "X"), (2, "Alex"), (3, "Student"), (4, "John"), (5, "Emma")]


def test_leaderboard_keeps_all_ties(spark):
    points = [(1, 50), (2, 40), (3, 40)] + [(i, 30) for i in range(4, 40)] + [(99, 10)]
    board = spark.createDataFrame(points, "learner bigint, points int")
    got = {r.learner: r.rank for r in goals.leaderboard(board, "learner", "points", 4).collect()}
    assert got == {1: 1, 2: 2, 3: 2, **{i: 4 for i in range(4, 40)}}
    assert goals.own_rank(board, "learner", "points", 39).first().rank == 4
    assert goals.own_rank(board, "learner", "points", 99).first().rank == 40
    assert goals.own_rank(board, "learner", "points", 1000).count() == 0


def test_weekday_profile(spark):
    hours = {"Mon": 2, "Tue": 4, "Wed": 5, "Thu": 3, "Fri": 6, "Sat": 8, "Sun": 7}
    frame = stamps(spark, [(1, datetime(2024, 5, 20 + i, 12), float(h)) for i, h in enumerate(hours.values())])
    got = activity.weekday_profile(frame, "ts", "minutes").collect()
    assert [r.label for r in got] == list(hours)
    assert sum(r.total for r in got) == 35


def test_streaks(spark):
    days = [1, 2, 3, 5, 6, 9, 10]
    data = [(1, datetime(2024, 5, d, 8), 1.0) for d in days] + [(1, datetime(2024, 5, 10, 9), 1.0), (2, datetime(2024, 5, 8), 1.0)]
    got = {r.learner: (r.current_streak, r.longest_streak) for r in activity.study_streak(stamps(spark, data), "learner", "ts", "2024-05-11").collect()}
    assert got == {1: (2, 3), 2: (0, 1)}


def test_period_change_fills_idle_weeks(spark):
    data = [(1, datetime(2024, 5, 6), 10.0), (1, datetime(2024, 5, 8), 10.0), (1, datetime(2024, 5, 27), 5.0)]
    got = activity.period_change(stamps(spark, data), "learner", "ts", "minutes", "week", "2024-06-05").orderBy("period").collect()
    assert [(r.period, r.total, r.change_pct) for r in got] == [
        (date(2024, 5, 6), 20.0, None),
        (date(2024, 5, 13), 0.0, -100.0),
        (date(2024, 5, 20), 0.0, None),
        (date(2024, 5, 27), 5.0, None),
        (date(2024, 6, 3), 0.0, -100.0),
    ]


def test_daily_series_sums_to_study_time(spark):
    data = [(k, datetime(2024, 5, 1) + timedelta(hours=7 * i), i / 4) for k in (1, 2) for i in range(20)]
    frame = stamps(spark, data)
    series = activity.daily_series(frame, "learner", "ts", "minutes", "2024-05-01", "2024-05-08")
    assert series.count() == 14
    total = {r.learner: r.minutes for r in activity.study_time(frame, "learner", "minutes").collect()}
    assert {r.learner: r.s for r in series.groupBy("learner").agg(F.sum("total").alias("s")).collect()} == total


def test_sessions_keep_a_gap_equal_to_the_limit(spark):
    start = datetime(2024, 5, 1)
    data = [(1, start + timedelta(minutes=m), 1.0) for m in (0, 30, 60, 91, 200)]
    got = activity.focus_sessions(stamps(spark, data), "learner", "ts", "minutes", timedelta(minutes=30)).orderBy("session_start").collect()
    assert [r.n for r in got] == [3, 1, 1]


def test_sessions_do_not_follow_a_change_of_clocks(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    data = [(1, datetime(2024, 3, 10, 1, 40), 1.0), (1, datetime(2024, 3, 10, 3, 9), 1.0), (2, datetime(1969, 12, 31, 23, 59), 1.0)]
    frame = spark.createDataFrame(data, "learner int, ts timestamp_ntz, minutes double")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = activity.focus_sessions(frame, "learner", "ts", "minutes", timedelta(minutes=70)).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted((r.learner, r.n) for r in got) == [(1, 1), (1, 1), (2, 1)]


def test_own_rank_of_a_text_key(spark):
    board = spark.createDataFrame([("Ann", 5), ("Bo", 9)], "name string, points int")
    got = goals.own_rank(board, "name", "points", "Ann").first()
    assert (got["name"], got.rank) == ("Ann", 2)


def test_sessions_of_a_busy_learner(spark):
    chance = random.Random(5)
    start = datetime(2024, 5, 1)
    data = [(1 if i % 3 else i % 7, start + timedelta(seconds=chance.randrange(3_000_000)), 1.0) for i in range(3000)]
    gap = timedelta(minutes=17)
    expected = []
    for learner in {r[0] for r in data}:
        times = sorted(r[1] for r in data if r[0] == learner)
        first = last = times[0]
        n = 0
        for moment in times:
            if moment - last > gap:
                expected.append((learner, first, last, n))
                first, n = moment, 0
            last, n = moment, n + 1
        expected.append((learner, first, last, n))
    got = activity.focus_sessions(stamps(spark, data), "learner", "ts", "minutes", gap).collect()
    assert sorted((r.learner, r.session_start, r.last_activity, r.n) for r in got) == sorted(expected)


def test_filters_reach_the_scan(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    month = activity.in_period(events, "ts", "month", "2024-01-20 10:00:00").groupBy("user_id").agg(F.sum("value"))
    plan = month._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,2024-01-01T00:00), LessThan(ts,2024-01-20T10:00)]" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in plan


def test_badges(spark):
    metrics = spark.createDataFrame([(1, 7, 3), (2, 1, None)], "k int, days int, quizzes int")
    got = {r.k: (r.badges, r.n_badges) for r in goals.award_badges(metrics, "k", [("Week", "days", 7), ("Quiz", "quizzes", 1)]).collect()}
    assert got == {1: ("Week, Quiz", 2), 2: ("", 0)}


def test_quiz_measures(spark):
    answers = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, None), (2, 2, True)], "quiz int, learner int, correct boolean")
    scores = progress.quiz_scores(answers, ["learner"])
    assert {r.learner: (r.correct, r.total) for r in scores.collect()} == {1: (1, 2), 2: (1, 2)}
    assert {r.accuracy for r in progress.quiz_accuracy(scores, "learner").collect()} == {50.0}


def test_grade_counts_missing_answers_as_wrong(spark):
    given = spark.createDataFrame([(1, "q1", "a"), (1, "q2", None), (1, "q3", "a"), (1, "q1", "a")], "t int, q string, answer string")
    key = spark.createDataFrame([("q1", "a"), ("q2", "b")], "q string, solution string")
    got = progress.grade(given, key, "t", "q").first()
    assert (got.score, got.accuracy) == ("2/4", 50.0)


def test_patches(spark):
    base = spark.createDataFrame([(1, "Ann", "a@x", "pass"), (2, "Bo", "b@x", "win")], "id int, name string, email string, goal string")
    at = datetime(2024, 5, 1)
    patches = [(1, "goal", "top", at, 1), (1, "goal", "best", at, 2), (2, "email", None, at, 1), (3, "goal", "x", at, 1)]
    frame = spark.createDataFrame(patches, "id int, field string, value string, ts timestamp_ntz, seq int")
    got = rows.apply_patches(base, frame, "id", ["name", "email", "goal"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "Ann", "a@x", "best"), (2, "Bo", None, "win")]


def test_row_operators(spark):
    chat = spark.createDataFrame([("assistant", "Hello"), ("user", "  hi  "), ("user", "   "), ("user", None)], "role string, content string")
    assert [r.content for r in rows.drop_blank(chat, "content").collect()] == ["Hello", "hi"]
    nothing = rows.or_default_row(chat.where("role = 'x'"), {"content": "No messages"}).collect()
    assert [tuple(r) for r in nothing] == [(None, "No messages")]
    assert rows.or_default_row(chat, {"content": "No messages"}).count() == 4
    old = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "c int, turn bigint, text string")
    new = spark.createDataFrame([(1, 1, "c"), (1, 2, "d"), (2, 1, "e")], "c int, turn bigint, text string")
    assert sorted(tuple(r) for r in rows.append(old, new, "c", "turn").collect()) == [
        (1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d"), (2, 0, "e")
    ]
    assert [r.i for r in rows.expand_n(spark.createDataFrame([(3,), (0,), (None,)], "n int"), "n").collect()] == [0, 1, 2]
    assert rows.fields(old, "text", "title").schema.simpleString() == "struct<text:string,title:string>"
    assert [r.turn for r in rows.newest_first(old, "turn", "text").collect()] == [1, 0]


def test_sharing(spark):
    learners = spark.createDataFrame([(1, "Ann", True), (2, "Bo", False), (3, "Cy", None)], "k int, name string, visible boolean")
    board = spark.createDataFrame([(1, 5), (2, 6), (3, 7), (4, 8)], "k int, points int")
    assert [r.k for r in feeds.visible_only(board, learners, "k").collect()] == [1]
    masked = feeds.mask_hidden(board, learners, "k").orderBy("k").collect()
    assert [r.name for r in masked] == ["Ann", "Student", "Student", "Student"]


def test_learners_by_week_are_counted_exactly(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(oracle, "TABLES", ("events",))
    n = 40_000  # more than sketches count without an error
    at = F.expr("timestamp_ntz'2024-01-08 00:00:00' + make_dt_interval(cast(id % 9 as int))")
    events = spark.range(2 * n).select((F.col("id") % n).alias("user_id"), at.alias("ts"))
    nobody = spark.range(3).select(F.lit(None).cast("bigint").alias("user_id"), F.lit("2024-01-28 23:00:00").cast("timestamp_ntz").alias("ts"))
    events.unionByName(nobody).write.parquet(f"{tmp_path}/events.parquet")
    problems, rows, _ = oracle.differences(spark, str(tmp_path), "learners_by_week", QUERIES, ORACLES)
    assert not problems and rows == 3


def test_sketches_of_days_are_close(spark):
    at = F.expr("timestamp_ntz'2024-01-08 00:00:00' + make_dt_interval(cast(id % 9 as int))")
    events = spark.range(80_000).select((F.col("id") % 40_000).alias("user_id"), at.alias("ts"))
    row = feeds.distinct_in_period(feeds.distinct_per_day(events, "ts", "user_id"), "2024-01-08", "2024-01-17").first()
    assert abs(row["n"] - 40_000) < 0.02 * 40_000
