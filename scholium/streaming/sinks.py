"""Sinks that may be written again after a failure without changing the result."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from scholium.plans import scratch_dir
from scholium.sources.keyed import KeyedTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _stream_settings(spark: SparkSession, partitions: int | None) -> Iterator[None]:
    """Settings a stream takes over when it starts; the session has its own again afterwards.

    State lives in RocksDB instead of the executors' heap, and sessions are merged before they are shuffled. A new
    stream fixes its number of state partitions for good: ``partitions``, by default one per core of the moment.
    """
    wanted = {
        "spark.sql.shuffle.partitions": str(partitions or spark.sparkContext.defaultParallelism),
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def append_parquet(stream: DataFrame, path: str, checkpoint: str, once: bool = True, partitions: int | None = None) -> StreamingQuery:
    """Append finished rows; the file sink's log makes a repeated batch harmless."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    with _stream_settings(stream.sparkSession, partitions):
        return writer.start(path)


def upsert_table(stream: DataFrame, table: KeyedTable, checkpoint: str, once: bool = True, partitions: int | None = None) -> StreamingQuery:
    """Keep a keyed table up to date with the changed rows of each batch; it can be read all the while.

    A repeated batch is left alone, and a new query on another checkpoint goes on with the same table.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, checkpoint, batch_id)

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)
    if once:
        writer = writer.trigger(availableNow=True)
    with _stream_settings(stream.sparkSession, partitions):
        return writer.start()


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Process all available input of an append-mode stream once and read the result back."""
    spark = stream.sparkSession
    target = scratch_dir(spark, name)
    append_parquet(stream, f"{target}/rows", f"{target}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}/rows")
