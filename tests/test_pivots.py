"""Search beside pivots against comparing everything with everything."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from scholium.functions.kernels import unit_rows
from scholium.operators.pivots import angles, bounds, build_pivots, search_pivots
from scholium.operators.search import _hit_schema
from scholium.plans import top_per_key


@given(st.integers(0, 10**6), st.integers(2, 6))
@settings(max_examples=80, deadline=None)
def test_no_cosine_is_above_its_bound(seed, width):
    rng = np.random.default_rng(seed)
    chunks, pivots, queries = (unit_rows(rng.normal(size=(n, width))) for n in (40, 4, 9))
    chunks[:4] = pivots
    cosines = chunks @ pivots.T
    nearest = cosines.argmax(axis=1)
    reach = np.array([angles(cosines[nearest == p, p]).max() for p in range(4)])
    most = bounds(queries, pivots, reach)
    for p in range(4):
        assert ((queries @ chunks[nearest == p].T) <= most[:, [p]] + 1e-9).all()


def clustered(rng, n, width=12, centres=8):
    """Vectors in tight groups, a third of all being copies of one."""
    middle = rng.normal(size=(centres, width)) * 5
    vectors = middle[rng.integers(0, centres, n)] + rng.normal(size=(n, width)) * 0.3
    vectors[: n // 3] = vectors[0]
    vectors[n - 1] = 0
    return vectors


@pytest.mark.parametrize("pivots, slab, name", [(16, 100, int), (5, 7, str), (1, 100, int), (1000, 3, int)])
def test_like_comparing_everything(spark, pivots, slab, name):
    rng = np.random.default_rng(4)
    vectors, queries = clustered(rng, 400), clustered(rng, 31)
    kind = "bigint" if name is int else "string"
    chunks = spark.createDataFrame([(name(i), v.tolist()) for i, v in enumerate(vectors)], f"id {kind}, v array<double>").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(queries)], "q string, v array<double>")
    index = build_pivots(chunks, "id", "v", 12, pivots=pivots)
    found = search_pivots(index, asked, "q", "v", 6, _hit_schema(asked, "q", chunks, "id"), slab)
    got = top_per_key(found, ["q"], [F.col("score").desc(), F.col("id")], 6).collect()
    scores = np.round(unit_rows(queries) @ unit_rows(vectors).T, 6)
    want = {}
    for q, row in enumerate(scores):
        ranked = sorted((i for i in range(400) if not np.isnan(row[i])), key=lambda i: (-row[i], name(i)))
        want.update({(f"q{q}", p): (name(i), row[i]) for p, i in enumerate(ranked[:6], 1)})
    assert {(r.q, r.position): r.id for r in got} == {key: i for key, (i, _) in want.items()}
    assert all(abs(r.score - want[r.q, r.position][1]) < 2e-6 for r in got)


def test_far_pivots_are_not_looked_at(spark):
    rng = np.random.default_rng(5)
    vectors, queries = clustered(rng, 2000), clustered(rng, 40)[:-1]
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id bigint, v array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "q bigint, v array<double>")
    compared = spark.sparkContext.accumulator(0)
    index = build_pivots(chunks, "id", "v", 12, pivots=64)
    search_pivots(index, asked, "q", "v", 3, _hit_schema(asked, "q", chunks, "id"), compared=compared).count()
    assert 0 < compared.value < 0.6 * len(vectors) * len(queries)


def test_no_chunks_and_no_directions(spark):
    schema = "id bigint, v array<double>"
    none, zero = spark.createDataFrame([], schema), spark.createDataFrame([(1, [0.0, 0.0])], schema)
    asked = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "q bigint, v array<double>")
    for chunks in (none, zero):
        index = build_pivots(chunks, "id", "v", 2)
        assert search_pivots(index, asked, "q", "v", 3, _hit_schema(asked, "q", chunks, "id")).collect() == []
    some = build_pivots(spark.createDataFrame([(1, [1.0, 1.0])], schema), "id", "v", 2)
    got = search_pivots(some, asked, "q", "v", 3, _hit_schema(asked, "q", none, "id")).collect()
    assert [(r.q, r.id) for r in got] == [(2, 1)]
