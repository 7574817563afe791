"""The keyed table: one row per key, whatever happened while it was written."""

import os
import random

import pytest

from scholium.sources import KeyedTable

SCHEMA = "k bigint, part string, v double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(table, version=None):
    return sorted(map(tuple, table.read(version).select("k", "part", "v").collect()), key=repr)


def files(path, pattern):
    return sorted(str(p.relative_to(path)) for p in path.glob(pattern))


def test_random_batches_like_a_dictionary(spark, tmp_path):
    chance, want = random.Random(2), {}
    table = KeyedTable(spark, str(tmp_path / "t"), ["k", "part"], buckets=5)
    for batch in range(6):
        rows = {(chance.choice([None, *range(30)]), chance.choice(["a", None])): float(batch) for _ in range(12)}
        assert table.upsert(frame(spark, [(*key, v) for key, v in rows.items()]), "s", batch)
        want.update(rows)
        assert content(table) == sorted([(*key, v) for key, v in want.items()], key=repr)


def test_only_touched_buckets_are_written_and_dead_files_go(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["k"], buckets=8, keep=1)
    table.upsert(frame(spark, [(i, "x", 0.0) for i in range(200)]))
    first = table.manifest()["written"]
    assert len(first) == 8
    for turn in range(1, 6):
        table.upsert(frame(spark, [(7, "y", float(turn))]))
    written = table.manifest()["written"]
    assert sorted(written.values()) == [0] * 7 + [5] and table.versions() == [5]
    # As many folders as there are buckets: reading costs one version per key.
    assert len(files(tmp_path, "rows/*/_bucket=*")) == 8 and len(files(tmp_path, "manifest/*")) == 1
    assert table.read().count() == 200
    assert content(table)[7] == (16, "x", 0.0) or (7, "y", 5.0) in content(table)


def test_a_repeated_batch_is_left_alone(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["k"])
    assert table.upsert(frame(spark, [(1, "a", 1.0)]), "s", 0)
    assert table.upsert(frame(spark, [(1, "a", 2.0)]), "s", 1)
    assert not table.upsert(frame(spark, [(1, "a", 1.0)]), "s", 0)
    assert content(table) == [(1, "a", 2.0)]
    # Another stream counts its own batches.
    assert table.upsert(frame(spark, [(2, "b", 3.0)]), "other", 0)
    assert content(table) == [(1, "a", 2.0), (2, "b", 3.0)]


def test_a_write_that_broke_off_is_not_read_and_can_be_repeated(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["k"], buckets=2)
    table.upsert(frame(spark, [(i, "a", 1.0) for i in range(6)]), "s", 0)
    table.upsert(frame(spark, [(i, "b", 2.0) for i in range(3)]), "s", 1)
    os.remove(tmp_path / "manifest/version=1/_SUCCESS")
    assert {r[1] for r in content(table)} == {"a"}
    table.upsert(frame(spark, [(i, "b", 2.0) for i in range(3)]), "s", 1)
    assert [r[1] for r in content(table)] == ["b"] * 3 + ["a"] * 3


def test_earlier_versions_stay_readable_while_kept(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["k"], buckets=2, keep=2)
    for turn in range(4):
        table.upsert(frame(spark, [(1, "a", float(turn))]))
    assert table.versions() == [2, 3]
    assert content(table, 2) == [(1, "a", 2.0)] and content(table) == [(1, "a", 3.0)]


def test_empty_changes_new_columns_and_wrong_keys(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["k"], buckets=2)
    with pytest.raises(ValueError):
        table.read()
    assert table.upsert(frame(spark, []))
    table.upsert(frame(spark, [(1, "a", 1.0), (1, "a", 1.0), (2, "b", 2.0)]))
    table.upsert(frame(spark, [(2, "c", 2.0)]).selectExpr("k", "part", "v", "'n' AS more"))
    assert len(content(table)) == 2
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path), ["part"]).read()
