"""Row operators of the screens: append, newest first, patches, fallbacks, positions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions.text import trim_all
from scholium.plans import number_rows


def drop_blank(df: DataFrame, text: str) -> DataFrame:
    """Trim a text column and drop the rows it leaves empty (and those it was null in)."""
    return df.withColumn(text, trim_all(text)).where(F.length(text) > 0)


def append(df: DataFrame, rows: DataFrame, group: str, sequence: str) -> DataFrame:
    """Add rows after the last one of their group.

    ``rows`` numbers its own rows from 1 in ``sequence``; they continue the group's numbers
    (a new group starts at 0).
    """
    last = df.groupBy(group).agg(F.max(sequence).alias("_last"))
    moved = (
        rows.join(last, group, "left")
        .withColumn(sequence, F.coalesce("_last", F.lit(-1)) + F.col(sequence))
        .drop("_last")
    )
    return df.unionByName(moved)


def newest_first(df: DataFrame, ts: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc())


def apply_patches(
    base: DataFrame,
    patches: DataFrame,
    key: str,
    fields: Sequence[str],
    field: str = "field",
    value: str = "value",
    order: Sequence[str] = ("ts", "seq"),
) -> DataFrame:
    """Last write wins per field; untouched fields survive and a null write overrides."""

    def last_write(name: str) -> Column:
        of_field = F.col(field) == name
        wrapped = F.when(of_field, F.struct(F.col(value).alias("v")))
        return F.max_by(wrapped, F.when(of_field, F.struct(*order))).alias(f"_{name}")

    latest = patches.where(F.col(field).isin(*fields)).groupBy(key).agg(*[last_write(f) for f in fields])
    patched = base.join(latest, key, "left")
    for name in fields:
        patched = patched.withColumn(
            name, F.when(F.col(f"_{name}").isNotNull(), F.col(f"_{name}.v")).otherwise(F.col(name))
        )
    return patched.select(*base.columns)


def or_default_row(df: DataFrame, row: Mapping[str, Any]) -> DataFrame:
    """``df``, or the one given row when it is empty; decided inside the plan."""
    empty = df.limit(1).agg(F.count("*").alias("n")).where(F.col("n") == 0)
    default = empty.select(
        *[F.lit(row.get(field.name)).cast(field.dataType).alias(field.name) for field in df.schema]
    )
    return df.unionByName(default)


def with_position(
    df: DataFrame, order: Sequence[Column], group: Sequence[str] = (), position: str = "position"
) -> DataFrame:
    """1-based position of each row in an explicit order."""
    return number_rows(df, order, group, position)


def expand_n(df: DataFrame, n: str | Column, into: str = "i") -> DataFrame:
    """``n`` copies of each row, counted from 0; no copy when ``n`` is zero or missing."""
    times = F.col(n) if isinstance(n, str) else n
    indexes = F.when(times > 0, F.sequence(F.lit(0).cast("bigint"), times.cast("bigint") - 1))
    return df.withColumn(into, F.explode(indexes))


def fields(df: DataFrame, *names: str) -> DataFrame:
    """Projection by name; a field the table does not have is null."""
    return df.select(
        *[F.col(name) if name in df.columns else F.lit(None).cast("string").alias(name) for name in names]
    )
