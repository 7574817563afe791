"""The plan helpers with a key that holds most of the rows, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from scholium.plans import lead_in_order, number_rows, positions, salted_join, top_per_key, weighted_lookup
from scholium.plans.skew import heavy_keys


@pytest.fixture(scope="module")
def rows(spark):
    chance = random.Random(3)
    data = [("hot" if i % 3 else f"k{chance.randrange(200)}", chance.randrange(50), i) for i in range(20_000)]
    return data, spark.createDataFrame(data, "k string, v int, i bigint").repartition(7)


@pytest.mark.parametrize("group_bytes, most", [(64 << 20, 9), (100_000, 9), (0, 10_000), (0, 9)])
def test_number_rows_in_groups(rows, group_bytes, most, monkeypatch):
    """No large group, one, all of them, and more of them than are broadcast."""
    monkeypatch.setattr(positions, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(positions, "MOST_LARGE", most)
    data, df = rows
    got = number_rows(df, [F.col("v").desc(), F.col("i")], ["k"], "position", "size").collect()
    expected = {}
    for k, v, i in sorted(data, key=lambda r: (r[0], -r[1], r[2])):
        expected.setdefault(k, []).append(i)
    assert len(got) == len(data)
    assert all(expected[r.k][r.position - 1] == r.i and r.size == len(expected[r.k]) for r in got)


@pytest.mark.parametrize("group_bytes", [64 << 20, 0])
def test_number_rows_without_a_group_value(spark, group_bytes, monkeypatch):
    monkeypatch.setattr(positions, "GROUP_BYTES", group_bytes)
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "k string, i int")
    got = sorted((r.k or "", r.i, r.position) for r in number_rows(df, [F.col("i")], ["k"]).collect())
    assert got == [("", 1, 1), ("", 3, 2), ("a", 2, 1)]


@pytest.mark.parametrize("group_bytes", [64 << 20, 100_000, 0])
def test_number_rows_with_a_lookup(spark, rows, group_bytes, monkeypatch):
    monkeypatch.setattr(positions, "GROUP_BYTES", group_bytes)
    data, df = rows
    names = spark.createDataFrame([("hot", "x", 1), ("k3", "y", 2)], "k string, name string, other int")
    got = number_rows(df, [F.col("i")], ["k"], lookup=names)
    assert got.columns == ["k", "v", "i", "name", "other", "position"]
    want = {"hot": ("x", 1), "k3": ("y", 2)}
    found = got.collect()
    assert len(found) == len(data)
    assert all((r.name, r.other) == want.get(r.k, (None, None)) for r in found)


def test_small_groups_are_numbered_by_one_window(spark, rows):
    """No written copy, no literal per slice; the only exchange of the rows is by group."""
    plan = number_rows(rows[1], [F.col("i")], ["k"], lookup=rows[1].groupBy("k").agg(F.max("v").alias("most")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "RDD" not in text.replace("Scan ExistingRDD", "") and text.count("Window [") == 1
    assert "rangepartitioning" not in text


def test_row_bytes_of_all_kinds(spark):
    df = spark.createDataFrame([("añ", 1, [1, 2], None), (None, 2, None, b"abc")], "s string, i int, a array<int>, b binary")
    assert [r[0] for r in df.select(positions.row_bytes(df)).collect()] == [32 + 3 + 16, 32 + 3]


def test_number_rows_overall(rows):
    data, df = rows
    got = {r.i: (r.position, r.n) for r in number_rows(df, [F.col("v"), F.col("i")], size="n").collect()}
    assert number_rows(df.where("false"), [F.col("v")], size="n").count() == 0
    order = sorted(data, key=lambda r: (r[1], r[2]))
    assert got == {r[2]: (p, len(data)) for p, r in enumerate(order, 1)}


def test_lead_in_order_across_runs(rows):
    data, df = rows
    kept = [r for r in data if r[2] % 5]
    got = lead_in_order(df.where("i % 5 <> 0"), "k", "i", ["i", "v"], width=16).collect()
    follow = {}
    for k in {r[0] for r in kept}:
        group = sorted((r for r in kept if r[0] == k), key=lambda r: r[2])
        for row, after in zip(group, group[1:] + [None], strict=True):
            follow[row[2]] = after and (after[2], after[1])
    assert {r.i: r.next and (r.next.i, r.next.v) for r in got} == follow


@pytest.mark.parametrize("k", [3, 1500])
def test_top_per_key(rows, k):
    data, df = rows
    got = {(r.k, r.position): r.i for r in top_per_key(df, ["k"], [F.col("v").desc(), F.col("i")], k).collect()}
    expected = {}
    for key in {r[0] for r in data}:
        group = sorted((r for r in data if r[0] == key), key=lambda r: (-r[1], r[2]))
        expected.update({(key, p): r[2] for p, r in enumerate(group[:k], 1)})
    assert got == expected


def test_joins_keep_every_row(spark, rows):
    data, df = rows
    size = {}
    for k, _, _ in data:
        size[k] = size.get(k, 0) + 1
    known = [(k, n, f"name {k}") for k, n in size.items() if k != "k7"]
    names = spark.createDataFrame(known, "k string, n int, name string")
    expected = sorted((i, None if k == "k7" else f"name {k}") for k, _, i in data)
    salted = salted_join(df, names, ["k"], ["i"], "left")
    weighted = weighted_lookup(df, names, ["k"], "n", "name", ["i"])
    assert sorted((r.i, r.name) for r in salted.collect()) == expected
    assert sorted((r.i, r.name) for r in weighted.collect()) == expected
    for tasks in (1, 2, 50, 500):
        assert sorted((r.i, r.name) for r in salted_join(df, names, ["k"], ["i"], "left", tasks).collect()) == expected
    inner = salted_join(df, names, ["k"], ["i"])
    assert inner.count() == len([k for k, _, _ in data if k != "k7"])
    with pytest.raises(ValueError):
        salted_join(df, names, ["k"], ["i"], "full")


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("explode(")


def test_heavy_keys_and_their_shares(spark, rows):
    data, df = rows
    heavy = dict(heavy_keys(df, ["k"], 30))
    key = df.where("k = 'hot'").select(F.xxhash64("k")).first()[0]
    # Two thirds of the rows are twenty of thirty shares; no other key has a share.
    assert set(heavy) == {key} and 20 <= heavy[key] <= 21
    assert heavy_keys(df.where("k <> 'hot'"), ["k"], 30) == []
    assert heavy_keys(df.where("false"), ["k"], 30) == []


def test_only_heavy_keys_are_salted(spark, rows):
    df = rows[1]
    names = df.select("k").distinct().withColumn("name", F.upper("k"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "30"
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        even = salted_join(df.where("k <> 'hot'"), names.where("k <> 'hot'"), ["k"], ["i"], "left", 30)
        skewed = salted_join(df, names, ["k"], ["i"], "left", 30)
        # One exchange of the facts and one of the names (besides that of their distinct): nothing is repeated.
        assert exchanges(even) == (2, 0)
        assert exchanges(skewed)[1] == 1
        # No task gets more than a few shares of the hot key.
        sizes = [r[0] for r in skewed.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert max(sizes) < 0.5 * len(rows[0])
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_top_per_key_is_cut_before_the_shuffle(rows):
    plan = top_per_key(rows[1], ["k"], [F.col("v")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_window_gets_as_many_tasks_as_its_bytes_ask_for(spark, monkeypatch):
    monkeypatch.setattr(positions, "TASK_BYTES", 1000, raising=False)
    monkeypatch.setattr(positions, "BUCKETS", 50, raising=False)
    df = spark.range(3000).select((F.col("id") % 1000).alias("k"), F.col("id").alias("i"))
    got = number_rows(df, [F.col("i")], ["k"], size="n", lookup=df.groupBy("k").agg(F.max("i").alias("most")))
    assert got.rdd.getNumPartitions() >= 3000 * 16 // 1000
    assert sorted(map(tuple, got.select("k", "i", "position", "n", "most").collect())) == sorted(
        (i % 1000, i, i // 1000 + 1, 3, i % 1000 + 2000) for i in range(3000)
    )
