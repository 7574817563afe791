"""Exact cosine search for any number of queries over chunks that lie beside their pivots.

Chunks are written once, sorted by the nearest of a few pivot vectors. No chunk of a pivot is further from it than the pivot's reach,
an angle, so a query at a larger angle from the pivot can come no closer than the difference: that bounds its cosine
with all of them. Queries travel to the chunks, a slab of them at a time. Each is first compared with the
chunks of its nearest pivot; then only with those of pivots whose bound reaches the k-th best score found so far. Pivots that no query of a
slab needs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from scholium.functions.kernels import BestAbove, floors_of, id_array, unit_rows
from scholium.operators.terms import SCORE_DIGITS
from scholium.plans import scratch_dir

PIVOTS = 256
SLAB_QUERIES = 4096
# Numbers held in one score matrix of a task.
MATRIX_CELLS = 8_000_000
# Scores are rounded and angles computed, so a bound this much below a score may still reach it.
SLACK = 2 * 10.0**-SCORE_DIGITS


@dataclass(frozen=True)
class PivotIndex:
    """``chunks``: id, vector, pivot, on disk and sorted by pivot; unit vectors of the pivots and the angles they reach."""

    chunks: DataFrame
    pivots: np.ndarray
    reach: np.ndarray


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return unit_rows(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64))


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def bounds(queries: np.ndarray, pivots: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The highest cosine a query (row) can have with any chunk of a pivot (column)."""
    return np.cos(np.maximum(angles(queries @ pivots.T) - reach, 0.0))


def build_pivots(chunks: DataFrame, chunk_id: str, vector: str, width: int, path: str | None = None, pivots: int = PIVOTS) -> PivotIndex:
    """Deal chunks to the nearest of ``pivots`` chunks (chosen by a hash of the id) and write them.

    Vectors must have ``width`` numbers; those without a direction are left out, as nothing is similar to them.
    """
    spark = chunks.sparkSession
    rows = chunks.select(F.col(chunk_id).alias("_id"), F.col(vector).cast("array<double>").alias("_vector"))
    nonzero = rows.where(F.exists("_vector", lambda x: x != 0))
    chosen = nonzero.orderBy(F.xxhash64("_id"), "_id").limit(pivots).select("_vector").collect()
    centres = unit_rows(np.array([r[0] for r in chosen], dtype=np.float64).reshape(-1, width))
    shared = spark.sparkContext.broadcast(centres)
    out = T.StructType([*rows.schema.fields, T.StructField("_pivot", T.IntegerType()), T.StructField("_angle", T.DoubleType())])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, MATRIX_CELLS // max(1, len(shared.value) + width))
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                cosines = _matrix(batch.column(1), width) @ shared.value.T
                best = cosines.argmax(axis=1)
                least = angles(cosines[np.arange(len(best)), best])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32)), pa.array(least)], names=out.names)

    path = path or scratch_dir(spark, "pivots")
    # Chunks of one pivot may be very many (copies of one vector): ranges of (pivot, id) stay even.
    nonzero.mapInArrow(nearest, out).repartitionByRange("_pivot", F.xxhash64("_id")).sortWithinPartitions("_pivot").write.parquet(path)
    table = spark.read.schema(out).parquet(path)
    reach = np.zeros(len(centres))
    for row in table.groupBy("_pivot").agg(F.max("_angle").alias("reach")).collect():
        reach[row["_pivot"]] = row["reach"]
    return PivotIndex(table.select("_id", "_vector", "_pivot"), centres, reach)


def search_pivots(
    index: PivotIndex,
    queries: DataFrame,
    query_id: str,
    vector: str,
    k: int,
    schema: T.StructType,
    slab_queries: int = SLAB_QUERIES,
    compared: Accumulator | None = None,
) -> DataFrame:
    """The best chunks of each query in each task (query, chunk, score), to be cut to ``k`` per query.

    ``compared`` adds up the pairs of a query and a chunk that were compared.
    """
    spark = queries.sparkSession
    hits = spark.createDataFrame([], schema)
    slabs = -(-queries.count() // slab_queries)
    slab = F.pmod(F.xxhash64(query_id), F.lit(max(slabs, 1)))
    for number in range(slabs if len(index.pivots) else 0):
        rows = queries.where(slab == number).select(query_id, vector).collect()
        if not rows:
            continue
        units = unit_rows(np.array([r[1] for r in rows], dtype=np.float64))
        told = ~np.isnan(units).any(axis=1)
        names = [r[0] for r, keep in zip(rows, told) if keep]
        units = units[told]
        if not names:
            continue
        numbers = {name: i for i, name in enumerate(names)}
        most = bounds(units, index.pivots, index.reach)
        own = np.zeros(most.shape, dtype=bool)
        own[np.arange(len(names)), (units @ index.pivots.T).argmax(axis=1)] = True
        first = _compare(index, names, units, own, None, k, schema, compared).collect()
        floors = floors_of(first, numbers, k)
        others = (most + SLACK >= floors[:, None]) & ~own
        rest = _compare(index, names, units, others, floors, k, schema, compared)
        hits = hits.unionByName(spark.createDataFrame(first, schema)).unionByName(rest)
    return hits


def _compare(
    index: PivotIndex, names: list, units: np.ndarray, wanted: np.ndarray, floors: np.ndarray | None, k: int, schema: T.StructType, compared
) -> DataFrame:
    """Compare each query with the chunks of the pivots it wants."""
    needed = np.flatnonzero(wanted.any(axis=0)).tolist()
    shared = index.chunks.sparkSession.sparkContext.broadcast((names, units, wanted, floors))
    kinds = [to_arrow_type(field.dataType) for field in schema.fields]
    width = units.shape[1]

    def best_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_names, vectors, asks, least = shared.value
        best = BestAbove(k, len(query_names), least)
        for batch in batches:
            pivots = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(pivots)) + 1).tolist(), len(pivots)]
            for start, stop in zip(cuts, cuts[1:]):
                asking = np.flatnonzero(asks[:, pivots[start]]) if stop > start else np.zeros(0, int)
                step = max(1, MATRIX_CELLS // (len(asking) + width))
                for a in range(start, stop if len(asking) else start, step):
                    part = batch.slice(a, min(step, stop - a))
                    scores = np.round(vectors[asking] @ _matrix(part.column(1), width).T, SCORE_DIGITS)
                    if compared is not None:
                        compared.add(scores.size)
                    ids = id_array(part.column(0))
                    for query in np.flatnonzero((scores >= best.floors[asking][:, None]).any(axis=1)).tolist():
                        best.offer(int(asking[query]), ids, scores[query])
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(best.columns(query_names), kinds)], names=schema.names)

    return index.chunks.where(F.col("_pivot").isin(needed)).mapInArrow(best_of_task, schema)
