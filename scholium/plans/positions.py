"""Row numbers and next rows over ordered groups of any size.

A plain window hands a whole group to one task. That is right for groups that fit in one; rows of larger ones are
range-partitioned on (group, order), so that such a group is cut into several ordered slices, and only one small row per
slice travels between them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholium.plans.durable import cut_lineage
from scholium.plans.skew import is_small

# monotonically_increasing_id() keeps the partition number above this many bits.
_ROW_BITS = 33
# A group of more bytes is cut into slices; up to so many of these are broadcast.
GROUP_BYTES = 64 << 20
MOST_LARGE = 200_000
# Groups are weighed by so many hash buckets first. A task of the window gets about so many bytes, and sorts in some ten times as much.
BUCKETS = 1 << 16
TASK_BYTES = 8 << 20


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row. Only texts and arrays need to be read for this."""
    fixed, sizes = 0, []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.coalesce(F.octet_length(column), F.lit(0)))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType)):
            sizes.append(8 * F.coalesce(F.greatest(F.size(column), F.lit(0)), F.lit(0)))
        fixed += 8
    total = F.lit(fixed).cast("bigint")
    for size in sizes:
        total = total + size
    return total


def number_rows(
    df: DataFrame,
    order: Sequence[Column],
    group: Sequence[str] = (),
    position: str = "position",
    size: str | None = None,
    lookup: DataFrame | None = None,
    always_slices: bool = False,
) -> DataFrame:
    """Add the 1-based position of each row in its group, and the group's size if asked for.

    ``order`` should decide every pair of rows; ties fall in an arbitrary order. One partial sum per bucket of groups, then one per
    group of the heavy buckets, finds the groups above ``GROUP_BYTES``: their rows are written once and numbered slice by slice, all
    others by one window, in as many tasks as their bytes ask for. Without
    ``group`` the whole table is such a group, and with ``always_slices`` every group is. ``df`` is read more than once and must give the same rows each time.
    ``lookup`` has at most one row per value of ``group``, whose other columns are added (null where there is none); it meets
    the rows where the groups are together anyway, so a hot group is no hot key of this join either.
    """
    if not group or always_slices:
        return _in_slices(df, order, list(group), position, size, lookup)
    weight = F.sum(row_bytes(df)).alias("_bytes")
    bucket = F.pmod(F.xxhash64(*group), F.lit(BUCKETS))
    buckets = cut_lineage(df.groupBy(bucket.alias("_bucket")).agg(weight))
    total = buckets.agg(F.sum("_bytes")).first()[0]
    tasks = math.ceil((total or 0) / TASK_BYTES)
    heavy = buckets.where(F.col("_bytes") > GROUP_BYTES).select("_bucket")
    suspects = df.withColumn("_bucket", bucket).join(F.broadcast(heavy), "_bucket", "left_semi")
    large = suspects.groupBy(*group).agg(weight).where(F.col("_bytes") > GROUP_BYTES).select(F.struct(*group).alias("_group"))
    if heavy.isEmpty() or large.isEmpty():
        return _in_window(df, order, group, position, size, lookup, tasks)
    large = _light(cut_lineage(large))
    keyed = df.withColumn("_group", F.struct(*group))
    small = keyed.join(large, "_group", "left_anti").drop("_group")
    cut = keyed.join(large, "_group", "left_semi").drop("_group")
    return _in_window(small, order, group, position, size, lookup, tasks).unionByName(
        _in_slices(cut, order, group, position, size, lookup)
    )


def _light(table: DataFrame) -> DataFrame:
    """``table``, marked for a broadcast if it is counted to have few enough rows."""
    return F.broadcast(table) if is_small(table, MOST_LARGE) else table


def _in_window(df, order, group, position, size, lookup, tasks) -> DataFrame:
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        df = df.repartition(tasks, *group)
        # A table with a row per group would be large for a broadcast, whatever its files have shrunk to.
        lookup = lookup if lookup is None else lookup.repartition(tasks, *group).hint("merge")
    if lookup is not None:
        df = df.join(lookup, list(group), "left").select(*df.columns, *[c for c in lookup.columns if c not in group])
    of_group = Window.partitionBy(*group)
    numbered = df.withColumn(position, F.row_number().over(of_group.orderBy(*order)).cast("bigint"))
    return numbered if size is None else numbered.withColumn(size, F.count("*").over(of_group))


def _in_slices(df, order, group, position, size, lookup) -> DataFrame:
    ranges = [F.col(g) for g in group] + list(order)
    # Written once: range bounds are sampled, so a recomputed partition could differ.
    placed = cut_lineage(
        df.repartitionByRange(*ranges).sortWithinPartitions(*ranges).withColumn("_row", F.monotonically_increasing_id())
    ).withColumn("_slice", F.shiftright("_row", _ROW_BITS))
    cells = placed.groupBy("_slice", *group).agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    of_group = Window.partitionBy(*group)
    earlier = of_group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).withColumn(
        "_size", F.sum("_rows").over(of_group)
    )
    added = [] if lookup is None else [c for c in lookup.columns if c not in group]
    if lookup is not None:
        starts = starts.join(lookup, list(group), "left")
    # About one row per partition and group. Compared as one struct, so that rows without a group value form a group too.
    cell = F.struct("_slice", *group).alias("_cell")
    starts = starts.select(cell, "_first", "_start", "_size", *added)
    joined = placed.select(*df.columns, "_row", cell).join(_light(starts), "_cell")
    at = F.col("_row") - F.col("_first") + F.col("_start") + 1
    numbered = [at.cast("bigint").alias(position)] + ([] if size is None else [F.col("_size").cast("bigint").alias(size)])
    return joined.select(*df.columns, *added, *numbered)


def lead_in_order(
    df: DataFrame,
    group: str,
    sequence: str,
    fields: Sequence[str],
    into: str = "next",
    width: int = 4096,
) -> DataFrame:
    """Add a struct of the next row's ``fields`` in each group, in order of an integer ``sequence``.

    (group, sequence) is taken as the identity of a row. Groups are cut into runs of ``width``
    sequence numbers; the last row of a run takes the first row of the run that follows.
    """
    run = F.floor(F.col(sequence) / width)
    in_run = Window.partitionBy(group, "_run").orderBy(sequence)
    of_group = Window.partitionBy(group).orderBy("_run")
    picked = F.struct(*fields)
    cut = df.withColumn("_run", run)
    # Only run numbers, one per ``width`` sequence numbers, meet in a window over the whole group.
    runs = cut.select(group, "_run").distinct()
    next_runs = runs.withColumn("_next_run", F.lead("_run").over(of_group)).where(F.col("_next_run").isNotNull())
    heads = cut.groupBy(group, F.col("_run").alias("_next_run")).agg(F.min_by(picked, sequence).alias("_follow"))
    follows = next_runs.join(heads, [group, "_next_run"]).drop("_next_run")
    within = cut.withColumn("_next", F.lead(picked).over(in_run))
    return (
        within.join(follows, [group, "_run"], "left")
        .withColumn(into, F.coalesce("_next", "_follow"))
        .drop("_run", "_next", "_follow")
    )
