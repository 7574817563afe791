"""Joins and top-k that stay even under a hot key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

DEFAULT_SALTS = 16
# Most keys a frequent-items sketch keeps.
MOST_TRACKED = 100_000
# Share of all facts from which a key counts as frequent; also the most frequent keys there can be.
SHARES = 20_000


def heavy_keys(facts: DataFrame, on: Sequence[str], tasks: int) -> list[tuple[int, int]]:
    """Keys that hold more than a task's share of the rows, as (hash, tasks they deserve).

    One scan with a frequent-items sketch as aggregate: partial sketches of bounded size are merged, no key is shuffled.
    The sketch never misses a key above its error and may count one too high, which costs a task too many.
    There are fewer such keys than ``tasks``.
    """
    # Tracks eight times as many keys as there can be heavy ones, so the error is a small part of a task's share.
    tracked = min(max(8 * tasks, 1000), MOST_TRACKED)
    top = F.call_function("approx_top_k", F.xxhash64(*on), F.lit(min(tasks, tracked)), F.lit(tracked))
    found = facts.agg(top.alias("top"), F.count("*").alias("n")).first()
    fair = found["n"] / tasks
    return [(row["item"], math.ceil(row["count"] / fair)) for row in found["top"] if row["count"] > max(fair, 1)]


def salted_join(
    facts: DataFrame,
    dimension: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    tasks: int | None = None,
) -> DataFrame:
    """Join a large side to a much smaller one whose keys are unique.

    The weight of the keys is measured first. Rows of a key that holds more than the share of one of ``tasks`` (by default the
    session's shuffle partitions) are dealt, by ``spread_by``, to as many shares as it deserves, and the
    key's row of the dimension is repeated as often; a table without such keys is joined as it is. ``how`` may be inner
    or left; the keys of both sides have the same types.
    """
    if how not in ("inner", "left"):
        raise ValueError("a salted join repeats its right side: only inner and left are exact")
    tasks = tasks or int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_keys(facts, on, tasks)
    if not heavy:
        return facts.join(dimension, list(on), how)
    # Fewer rows than tasks.
    shares = F.broadcast(facts.sparkSession.createDataFrame(heavy, "_key bigint, _shares bigint"))
    key = F.xxhash64(*on).alias("_key")
    dealt = facts.select("*", key).join(shares, "_key", "left")
    dealt = dealt.withColumn("_share", F.pmod(F.xxhash64(*spread_by), F.coalesce("_shares", F.lit(1))))
    repeated = dimension.select("*", key).join(shares, "_key", "left")
    repeated = repeated.withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1)))
    joined = dealt.drop("_key", "_shares").join(repeated.drop("_key", "_shares"), [*on, "_share"], how)
    return joined.drop("_share")


def split_frequent(
    dimension: DataFrame, weight: str, total: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split a lookup table by ``weight``, an upper bound on the facts per key.

    A key is frequent when its weight is at least 1/SHARES of the sum of all weights, so there
    are at most SHARES frequent keys and they may be broadcast; any other key has less than
    1/SHARES of the facts, too few to overload a task. ``total`` is the sum where the caller has
    it at hand.
    """
    bar = (dimension.agg(F.sum(weight)).scalar() if total is None else total) / SHARES
    frequent = dimension.where(F.col(weight) >= bar).drop(weight)
    return F.broadcast(frequent), dimension.where(F.col(weight) < bar).drop(weight)


def fill_from(
    facts: DataFrame, others: DataFrame, on: Sequence[str], value: str, spread_by: Sequence[str]
) -> DataFrame:
    """Look up ``value`` for the facts in which it is still null, by keys that are all infrequent.

    Facts that need no lookup get a second key that matches nothing and spreads them evenly.
    """
    side = F.when(F.col(value).isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*spread_by), F.lit(1000)))
    # Always 0, but not for the optimizer, which would take a constant out of the join's keys.
    zero = F.pmod(F.xxhash64(*on), F.lit(1))
    found = others.select(*on, F.col(value).alias("_found"), zero.cast("int").alias("_side"))
    joined = facts.withColumn("_side", side.cast("int")).join(found, [*on, "_side"], "left")
    return joined.withColumn(value, F.coalesce(value, "_found")).drop("_found", "_side")


def weighted_lookup(
    facts: DataFrame,
    dimension: DataFrame,
    on: Sequence[str],
    weight: str,
    value: str,
    spread_by: Sequence[str],
    total: Column | None = None,
) -> DataFrame:
    """Left join of one ``value`` column from a table with unique keys, even under hot keys."""
    frequent, others = split_frequent(dimension, weight, total)
    return fill_from(facts.join(frequent, list(on), "left"), others, on, value, spread_by)


def top_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    position: str = "position",
) -> DataFrame:
    """First ``k`` rows per key with their 1-based position.

    Catalyst turns the bound into a group limit before the shuffle, so each task sends at most
    ``k`` rows of a key. It does so only up to its threshold; a larger ``k`` is first
    cut per share of the key, which bounds what any one task receives in the same way.
    """
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > threshold:
        share = F.pmod(F.xxhash64(*df.columns), F.lit(DEFAULT_SALTS))
        by_share = Window.partitionBy(*keys, "_share").orderBy(*order)
        df = (
            df.withColumn("_share", share)
            .withColumn(position, F.row_number().over(by_share))
            .where(F.col(position) <= k)
            .drop("_share", position)
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(position, F.row_number().over(window))
    return ranked.where(F.col(position) <= k).withColumn(position, F.col(position).cast("bigint"))


def collect_bounded(df: DataFrame, limit: int) -> list[Row] | None:
    """The rows of ``df`` when there are at most ``limit`` of them, else None."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def is_small(df: DataFrame, most: int) -> bool:
    """Whether ``df`` is counted to have at most ``most`` rows; counting stops there."""
    return df.limit(most + 1).count() <= most
