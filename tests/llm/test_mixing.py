import duckdb
import pytest

from scholium.llm.mixing import mix_sources, mixing_sql, poisson_steps
from scholium.llm.queries import LLM_ORACLES, LLM_QUERIES
from tests.llm.frames import FOLDER, clashing, documents, rows_of
from tests.oracle import differences


def test_same_rows_as_sql(spark):
    problems, rows, _ = differences(spark, FOLDER, "op5_mixing", LLM_QUERIES, LLM_ORACLES)
    assert not problems and rows > 0


def test_rates_null_sources_and_ids_like_sql(spark):
    rows = [(i if i % 50 else None, f"t{i}", None, [None, "a", "b", "c", "d"][i % 5], 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    weights = {"a": 5.0, "b": 0.5, "absent": 3.0, "c": 0.0}
    got = rows_of(mix_sources(df, weights, 1.5, seed="s", size=1.2))
    frame = df.toPandas().astype({"doc_id": "Int64"}).convert_dtypes()  # noqa: F841  (read by DuckDB)
    sql = mixing_sql("frame", weights, 1.5, seed="s", size=1.2)
    want = sorted(map(tuple, duckdb.sql(sql).fetchall()), key=repr)
    assert got == want
    by_source = {s: sum(r[3] == s for r in got) for s in ("a", "b", "c")}
    # Shares 5 : 0.5 : 1.5 of 2400 rows.
    assert abs(by_source["a"] - 1714) < 200 and abs(by_source["b"] - 171) < 60 and by_source["c"] == 0
    assert abs(len(got) - 2400) < 250


def test_order_is_global_and_repeats_exactly(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    first = mix_sources(docs, {"src0": 3.0}, partitions=4)
    again = mix_sources(docs.repartition(7), {"src0": 3.0}, partitions=4)
    assert [tuple(r) for r in first.collect()] == [tuple(r) for r in again.collect()]


def test_awkward_rows(spark):
    df = clashing(documents(spark))
    mixed = mix_sources(df, {"src0": 50.0}, size=8.0)
    assert mixed.columns == [c for c in df.columns if c != "copy_no"] + ["copy_no", "shuffle_key"]
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in df.collect()}
    assert mix_sources(documents(spark, []), {"src0": 1.0}).collect() == []
    assert mix_sources(df, {"src0": 0.0}, other_weight=0.0).collect() == []
    for bad in ({"a": -1.0}, {"a": float("nan")}, {"others": 1.0}):
        with pytest.raises(ValueError):
            mix_sources(df, bad)


def test_poisson_steps_end_at_one():
    for mean in (0.0, 0.01, 1.0, 7.5, 60.0):
        steps = poisson_steps(mean)
        assert steps == sorted(steps) and abs(steps[-1] - 1) < 1e-12
