"""Tables of one row per key that streams update while others read them.

Rows are dealt into hash buckets by key. A batch of changes rewrites only the buckets it touches and then commits a
manifest: for each bucket the version that wrote it last. Readers take the newest committed manifest, so they see one
file set with one row per key however many batches ran, and never half of a batch. What no kept manifest names any
more is deleted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("buckets", T.IntegerType()),
        T.StructField("keys", T.ArrayType(T.StringType())),
        # Bucket to the version that holds its rows, and stream to the last batch of it that was taken in.
        T.StructField("written", T.MapType(T.IntegerType(), T.LongType())),
        T.StructField("streams", T.MapType(T.StringType(), T.LongType())),
    ]
)


class _Folder:
    """The few file operations that a table needs, on whatever store its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = path.rstrip("/")
        self.store = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        place = self._at(name)
        return [s.getPath().getName() for s in self.store.listStatus(place)] if self.store.exists(place) else []

    def exists(self, name: str) -> bool:
        return self.store.exists(self._at(name))

    def remove(self, name: str) -> None:
        self.store.delete(self._at(name), True)


class KeyedTable:
    """``KeyedTable(spark, path, ["learner", "day"])``: ``upsert`` changed rows, ``read`` the latest of each key.

    One writer at a time; any number of readers. ``buckets`` is fixed by the first write and should leave buckets
    of the size of a file split. The last ``keep`` versions stay readable, so a reader has as long as
    that many batches take. Keys may be null; a null is a value like any other.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64, keep: int = 3):
        if keep < 1:
            raise ValueError("the last version must be kept")
        self.spark, self.path, self.keys, self.buckets, self.keep = spark, path.rstrip("/"), list(keys), buckets, keep
        self.folder = _Folder(spark, self.path)

    def versions(self) -> list[int]:
        """Committed versions that are still there, oldest first."""
        named = [name for name in self.folder.names("manifest") if name.startswith("version=")]
        # The marker is written last; a manifest without it belongs to a write that broke off.
        return sorted(int(n.removeprefix("version=")) for n in named if self.folder.exists(f"manifest/{n}/_SUCCESS"))

    def manifest(self, version: int | None = None) -> T.Row | None:
        known = self.versions()
        if not known:
            return None
        wanted = known[-1] if version is None else version
        row = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/version={wanted}").first()
        if row["keys"] != self.keys:
            raise ValueError(f"the table has the keys {row['keys']}")
        return row

    def _files(self, written: dict[int, int]) -> list[str]:
        return [f"{self.path}/rows/version={version}/_bucket={bucket}" for bucket, version in sorted(written.items())]

    def read(self, version: int | None = None) -> DataFrame:
        """All rows, one per key; those of an earlier version while it is kept."""
        found = self.manifest(version)
        if found is None:
            raise ValueError(f"nothing was written to {self.path} yet")
        return self.spark.read.parquet(*self._files(found["written"]))

    def upsert(self, changes: DataFrame, stream: str = "", batch: int | None = None) -> bool:
        """Replace the rows of the keys in ``changes`` and add new ones; of a key with several rows one is taken.

        ``batch`` numbers the batches of a ``stream``: one that was taken in already is left alone (and gives False).
        A write that broke off left nothing that is read, and is simply done again.
        """
        spark = changes.sparkSession
        before = self.manifest()
        streams = dict(before["streams"]) if before else {}
        if batch is not None and batch <= streams.get(stream, -1):
            return False
        version = before["version"] + 1 if before else 0
        buckets = before["buckets"] if before else self.buckets
        written = dict(before["written"]) if before else {}
        values = [c for c in changes.columns if c not in self.keys]
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")
        changes = changes.persist()
        try:
            # At most as many as there are buckets.
            touched = [row[0] for row in changes.select(bucket.alias("b")).distinct().collect()]
            if not touched:
                return True
            rows = changes.select(*self.keys, *values, F.lit(1).alias("_turn"))
            old = self._files({b: written[b] for b in touched if b in written})
            if old:
                rows = spark.read.parquet(*old).withColumn("_turn", F.lit(0)).unionByName(rows, allowMissingColumns=True)
                values = [c for c in rows.columns if c not in (*self.keys, "_turn")]
            # Dealt out by bucket, rows of a key are together as well: one shuffle for merging and writing.
            dealt = rows.withColumn("_bucket", bucket).repartition(len(touched), "_bucket")
            last = F.max_by(F.struct(*values) if values else F.lit(0), "_turn").alias("_row")
            latest = dealt.groupBy("_bucket", *self.keys).agg(last)
            target = f"{self.path}/rows/version={version}"
            latest.select("_bucket", *self.keys, *([] if not values else ["_row.*"])).write.mode("overwrite").partitionBy("_bucket").parquet(target)
        finally:
            changes.unpersist()
        written.update(dict.fromkeys(touched, version))
        if batch is not None:
            streams[stream] = batch
        row = spark.createDataFrame([(version, buckets, self.keys, written, streams)], MANIFEST)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        self._clean(version)
        return True

    def _clean(self, newest: int) -> None:
        """Delete manifests beyond the kept ones, then the buckets that no kept manifest names."""
        known = self.versions()
        for version in known[: -self.keep]:
            self.folder.remove(f"manifest/version={version}")
        kept = known[-self.keep :]
        named = {(v, b) for version in kept for b, v in self.manifest(version)["written"].items()}
        for name in self.folder.names("rows"):
            version = int(name.removeprefix("version="))
            if version > newest:
                continue
            inside = {int(b.removeprefix("_bucket=")) for b in self.folder.names(f"rows/{name}") if b.startswith("_bucket=")}
            live = {b for v, b in named if v == version}
            if not live:
                self.folder.remove(f"rows/{name}")
            for dead in inside - live if live else ():
                self.folder.remove(f"rows/{name}/_bucket={dead}")
