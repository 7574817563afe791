"""Every bound query against DuckDB on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry
from scholium.bindings import ORACLES, QUERIES
from tests.oracle import differences

# Queries that may find nothing on the smallest tables.
EMPTY: set[str] = set()
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_entry_gives_the_leaderboard(spark):
    board = entry(spark)
    assert board.columns == ["learner_id", "points", "rank", "rank_label", "medal"]
    assert [row.rank for row in board.collect()] == list(range(1, 11))


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows_as_sql(spark, name):
    problems, rows, _ = differences(spark, FOLDER, name, QUERIES, ORACLES)
    assert not problems
    assert rows > 0 or name in EMPTY
