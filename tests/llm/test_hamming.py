import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scholium.llm import hamming
from scholium.llm.hamming import nearest_codes
from scholium.llm.queries import LLM_ORACLES, LLM_QUERIES
from tests.llm.frames import FOLDER, rows_of
from tests.oracle import differences

SCHEMA = "vec_id long, embedding array<float>, label int, code string, id string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, None, "x", "y") for i, v in rows], SCHEMA)


def brute(rows, k):
    codes = sorted({(i, tuple((x or -1) >= 0 for x in v)) for i, v in rows if i is not None and v is not None})
    out = []
    for i, c in codes:
        if i % 10 == 0:
            near = sorted((sum(a != b for a, b in zip(c, d)), j) for j, d in codes if j != i)[:k]
            out += [(i, rank, j, distance) for rank, (distance, j) in enumerate(near, 1)]
    return sorted(out, key=repr)


def test_like_brute_force_with_ties_copies_and_nulls(spark):
    random.seed(2)
    base = [[random.choice([-1.0, 1.0]) for _ in range(64)] for _ in range(6)]
    rows = []
    for i in range(120):
        v = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 5, 30])):
            v[random.randrange(64)] *= -1
        rows.append((i, v))
    rows += [(500, None), (None, base[0]), (5, rows[5][1]), (7, [None] + base[1][1:] if rows[7][1] is None else rows[7][1])]
    rows += [(1000 + i, base[0]) for i in range(80)]
    assert rows_of(nearest_codes(vectors(spark, rows), F.col("vec_id") % 10 == 0, k=7)) == brute(rows, 7)


def test_few_rows_and_none(spark):
    one = [1.0] * 64
    assert nearest_codes(vectors(spark, [(0, one)]), F.col("vec_id") % 10 == 0).collect() == []
    assert rows_of(nearest_codes(vectors(spark, [(0, one), (3, one)]), F.col("vec_id") % 10 == 0)) == [(0, 1, 3, 0)]
    assert nearest_codes(vectors(spark, []), F.col("vec_id") % 10 == 0).collect() == []


def test_another_width_is_an_error(spark):
    with pytest.raises(PySparkException, match="64 elements"):
        nearest_codes(vectors(spark, [(0, [1.0] * 63)]), F.lit(True)).collect()


def test_same_rows_as_sql(spark):
    problems, rows, _ = differences(spark, FOLDER, "op4_hamming_topk", LLM_QUERIES, LLM_ORACLES)
    assert not problems and rows == 50


@pytest.mark.parametrize("cell", [7, 1 << 14])
def test_neither_probes_nor_met_codes_become_rows(spark, monkeypatch, cell):
    """Codes far from each other: a query needs several flips a segment, yet its rows are cells and nearest codes."""
    monkeypatch.setattr(hamming, "CELL_CODES", cell)
    random.seed(5)
    base = [random.choice([-1.0, 1.0]) for _ in range(64)]
    rows = [(i, [random.choice([-1.0, 1.0]) for _ in range(64)]) for i in range(150)]
    rows += [(i, base[:40] + [random.choice([-1.0, 1.0]) for _ in range(24)]) for i in range(150, 230)]  # one cell is large
    asked, plain = [], hamming._cell_search

    def spied(widths, bits, radius, keep):
        asked.append((bits, radius))
        return plain(widths, bits, radius, keep)

    monkeypatch.setattr(hamming, "_cell_search", spied)
    found = nearest_codes(vectors(spark, rows), F.col("vec_id") % 10 == 0, k=5)
    assert rows_of(found) == brute(rows, 5)
    assert max(radius for _, radius in asked) >= 2 and {bits > 0 for bits, _ in asked} == {cell < 230}


def test_ids_may_be_texts(spark):
    random.seed(8)
    rows = [(i, [random.choice([-1.0, 1.0]) for _ in range(64)]) for i in range(40)]
    named = vectors(spark, rows).withColumn("vec_id", F.format_string("%03d", "vec_id"))
    got = nearest_codes(named, F.col("vec_id").endswith("0"), k=3).collect()
    assert sorted((int(r.query_id), r.rank, int(r.neighbor_id), r.distance) for r in got) == sorted(brute(rows, 3))
