"""Small helpers that the text operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from scholium.plans import written

# Text that a task works on at a time, but for a single longer one.
SLICE_BYTES = 1 << 22


_caches: dict[str, Callable[[], None]] = {}


def task_cache(owner: str, clear: Callable[[], None]) -> None:
    """Announce what ``owner`` remembers in this worker from task to task; what other operators left there is dropped.

    Python workers are reused by the stages of a job, so without this they would hold the words of every operator.
    """
    _drop([name for name in _caches if name != owner])
    _caches[owner] = clear


def drop_caches() -> None:
    """Drop what other operators left in this worker, in tasks that remember nothing themselves."""
    _drop(list(_caches))


def _drop(names: list[str]) -> None:
    for name in names:
        _caches.pop(name)()
    if names:
        give_back()


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it


def give_back() -> None:
    """Return freed memory to the system.

    Allocators keep it for later, but a worker that waits for its next task stands beside the stages of the JVM.
    """
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run: Callable[..., pa.Table], *inputs) -> pa.Table:
    """``run(*inputs)`` for tasks that remember nothing: in a worker without memories, what it freed goes back."""
    drop_caches()
    out = run(*inputs)
    give_back()
    return out


def lean_batches(
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """The same for tasks that go through batches."""
    drop_caches()
    yield from run(batches)
    give_back()


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs that run inside send their Python tasks at most ``most`` rows at a time, for rows that are wide.

    Such a batch is in memory in the JVM and in Python at once. Plans that are run later go by the session's own setting.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores added until no column has it."""
    while name in taken:
        name += "_"
    return name


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def schema(*fields: tuple[str, T.DataType | str]) -> T.StructType:
    """A schema of nullable fields; types may be given as DDL words."""
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
             "binary": T.BinaryType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds[k] if isinstance(k, str) else k, True) for n, k in fields])


def filled(column: pa.Array) -> pa.Array:
    """Texts with null as the empty text."""
    return pc.fill_null(column, "")


def lowered(column: pa.Array) -> pa.Array:
    """Texts with A-Z lower-cased, null as the empty text; other letters stay as they are."""
    return pc.ascii_lower(filled(column))


def slices(batches: Iterator[pa.RecordBatch], at: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in runs whose texts (column ``at``) have at most ``most`` bytes together; a longer text is a run alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, end - start)
            start = end
