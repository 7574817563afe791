"""Parquet tables by name, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pin_utc(spark: SparkSession) -> SparkSession:
    """Event times carry no zone; fix the session's so that days do not depend on the machine."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


class Tables:
    """``Tables(spark, folder)("events")`` reads ``folder/events.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = pin_utc(spark)
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def spread(self, name: str, *keys: str) -> DataFrame:
        """The table for work that is heavy per row, such as splitting text.

        A table of fewer file splits than cores is shared out (by ``keys`` if any); one with
        enough splits is left as it is, so large inputs are never shuffled for this.
        """
        table = self(name)
        cores = self.spark.sparkContext.defaultParallelism
        return table.repartition(cores, *keys) if table.rdd.getNumPartitions() < cores else table


def parquet_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream a parquet table that is one file or a folder of files."""
    pin_utc(spark)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # A plain path must be a folder; a pattern that matches just this path may be either.
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def event_stream(
    spark: SparkSession, path: str, event_time: str = "ts", files_per_trigger: int | None = None
) -> DataFrame:
    """The same with the event time as a zoned timestamp, which watermarks need."""
    stream = parquet_stream(spark, path, files_per_trigger)
    return stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
