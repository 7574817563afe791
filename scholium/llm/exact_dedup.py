"""Exact deduplication that stays even when one text holds a large share of all rows.

Texts are equal when they are identical after lower-casing A-Z. Copies are combined three times: by the task
that reads them, per (digest, salt), and over the salt winners of a digest. Every combine groups by the full
text, so the digest that deals rows out does not decide equality. Only digests with a large share of the rows
get more than one salt; all others are complete after the second combine and go on by their SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholium.llm.texts import field_type, lean_batches, lowered, schema
from scholium.plans import cut_lineage
from scholium.plans.skew import SHARES

DEFAULT_SALTS = 16


def _digests(rows: DataFrame, id_type: T.DataType, key_bytes: int, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = lowered(batch.column(1))
            sha = [hashlib.sha256(t.as_buffer()).digest() for t in texts]
            columns = [batch.column(0), pa.array([d[:key_bytes] for d in sha], pa.binary()), pa.array(sha, pa.binary())]
            if with_text:
                columns.append(texts)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [("_id", id_type), ("_key", "binary"), ("_sha", "binary")] + [("_text", "string")] * with_text
    names = [name for name, _ in fields]
    return rows.mapInArrow(lambda batches: lean_batches(run, batches), schema(*fields))


def exact_dedup(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    salts: int = DEFAULT_SALTS,
    key_bytes: int = 32,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. A null text counts as empty; a null id is smaller than
    any other. Rows that repeat both id and text count in ``group_size``, and one of them stays. An
    empty table gives no rows; other columns are not read. ``key_bytes`` shortens the digest that deals rows
    out; texts that share a short digest are still told apart by content.
    """
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"))
    id_type = field_type(rows, "_id")
    members = cut_lineage(_digests(rows, id_type, key_bytes, with_text=False))
    total = members.count()
    # At most SHARES digests can be this frequent, so they may be broadcast.
    hot_keys = members.groupBy("_key").count().where(F.col("count") >= max(2, total / SHARES)).select("_key")
    texts = _digests(rows, id_type, key_bytes, with_text=True).join(
        F.broadcast(hot_keys.withColumn("_hot", F.lit(True))), "_key", "left"
    )
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("_id", F.spark_partition_id()), F.lit(salts))).otherwise(0)
    # The partial aggregate is the local combine; the shuffle brings (digest, salt) groups together.
    merged = (
        texts.withColumn("_salt", salt.cast("int"))
        .groupBy("_key", "_salt", "_text")
        .agg(F.max("_id").alias("keep_id"), F.count("*").alias("_n"), F.first("_hot").alias("_hot"), F.first("_sha").alias("_sha"))
    )
    winners = (
        merged.withColumn("_text", F.when(F.col("_hot"), F.col("_text")))
        .groupBy("_key", "_sha", "_text")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("_n").alias("group_size"), F.first("_hot").alias("_hot"))
    )
    groups = cut_lineage(winners.select("_sha", F.struct("keep_id", "group_size").alias("_group"), "_hot"))
    hot = F.broadcast(groups.where("_hot").select("_sha", F.col("_group").alias("_hot_group")))
    cold = groups.where("_hot is null").select(F.col("_sha").alias("_probe"), F.col("_group").alias("_cold_group"))
    # Rows already looked up probe with a shorter key, which matches nothing and deals them out evenly.
    probe = F.when(F.col("_hot_group").isNull(), F.col("_sha")).otherwise(F.unhex(F.hex(F.xxhash64("_id", "_sha"))))
    placed = (
        members.join(hot, "_sha", "left")
        .withColumn("_probe", probe)
        .join(cold, "_probe", "left")
        .withColumn("_group", F.coalesce("_hot_group", "_cold_group"))
        .select("_id", "_sha", F.col("_group.keep_id"), F.col("_group.group_size"))
    )
    # Among rows that repeat the id of the winner one stays; all others are dealt out evenly.
    best = F.col("_id").eqNullSafe(F.col("keep_id"))
    lane = F.when(best, F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("_id"), F.lit(1 << 20)))
    numbered = placed.withColumn("_lane", lane.cast("int"))
    first = F.row_number().over(Window.partitionBy("_sha", "_lane").orderBy("_lane")) == 1
    return numbered.select(
        F.col("_id").alias(id_column),
        "keep_id",
        "group_size",
        (best & first).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops; all columns stay.

    Rows are matched by id and text, so an id that is used for two texts keeps both. Of rows that repeat both
    id and text one stays.
    """
    own = schema(*[(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)], ("_sha", "binary"))
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha = [hashlib.sha256(t.as_buffer()).digest() for t in lowered(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sha, pa.binary())], names=own.names)

    kept = exact_dedup(docs, id_column, text_column).where("kept")
    key = f"c{docs.columns.index(id_column)}"
    keys = kept.select(F.unhex("text_sha256").alias("_sha"), F.xxhash64(id_column).alias("_h"))
    marked = docs.mapInArrow(lambda batches: lean_batches(run, batches), own).withColumn("_row", F.monotonically_increasing_id())
    marked = marked.withColumn("_h", F.xxhash64(key))
    # Copies of a hot text differ in id, so (text, id) deals them out evenly.
    joined = marked.join(keys, ["_sha", "_h"])
    # One row stays per text, also where rows repeat both id and text.
    first = F.row_number().over(Window.partitionBy("_sha", "_h").orderBy("_row")) == 1
    single = joined.withColumn("_first", first).where("_first")
    return single.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)])
