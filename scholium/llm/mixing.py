"""Mixing sources to target weights by Poisson replication.

Every row is repeated as often as a Poisson draw says whose mean is the repetition rate of its source: the share of
the mix that the source is to have, over the share it has. The draw inverts the Poisson distribution at a number
hashed from seed and id, so it does not depend on partitions and a lost task repeats it exactly. The
copies are then dealt over all partitions and ordered by a second hash.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.llm.texts import fresh

OTHERS = "others"
HEX_DIGITS = 13  # of an MD5: 52 bits, exact in a double


def unit_hash(seed: str, *values: Column) -> Column:
    """A number in [0, 1) from the seed and the values, the same on every engine that has MD5."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(v.cast("string"), F.lit("null")) for v in values])
    digits = F.substring(F.md5(text.cast("binary")), 1, HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**HEX_DIGITS))


def poisson_steps(mean: float) -> list[float]:
    """P(X <= 0), P(X <= 1), ... until the rest is below what a unit hash can tell from 1."""
    steps, k, total, log_p = [], 0, 0.0, -mean
    while k <= mean or 1.0 - total > 2.0**-54 and math.exp(log_p) > 2.0**-60:
        total += math.exp(log_p)
        steps.append(total)
        k += 1
        log_p += math.log(mean) - math.log(k) if mean > 0 else -math.inf
    return steps


def repetition_rates(
    docs: DataFrame, weights: Mapping[str, float], other_weight: float, source_column: str, size: float
) -> dict[str, float]:
    """Mean copies per row of each weighted source, and of all other sources together.

    ``weights`` and ``other_weight`` are relative shares of the mix; a weighted source without rows leaves its
    share to the rest. ``size`` is the expected number of rows of the mix, as a multiple of the rows there are.
    """
    source = F.col(source_column).cast("string")
    group = F.when(source.isin(list(weights)), source)  # null: any other source, or none
    counts = {row[0]: row[1] for row in docs.groupBy(group.alias("_group")).count().collect()}  # one row per weight
    shares = {name: weight for name, weight in weights.items() if counts.get(name)}
    if counts.get(None):
        shares[OTHERS] = other_weight
    total, whole = sum(counts.values()), sum(shares.values())
    rows = {name: counts.get(None if name == OTHERS and name not in weights else name, 0) for name in shares}
    return {name: size * total * share / whole / rows[name] for name, share in shares.items()} if whole else {}


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float],
    other_weight: float = 1.0,
    seed: str = "mix",
    id_column: str = "doc_id",
    source_column: str = "source",
    size: float = 1.0,
    partitions: int | None = None,
    copy_column: str = "copy_no",
    key_column: str = "shuffle_key",
) -> DataFrame:
    """The mix: every column of ``docs``, then the number of the copy (from 1) and the key of its place.

    Rows of sources without a weight, null included, share ``other_weight`` in proportion to their number. Rows that
    repeat an id are drawn alike. The mix is in order of (partition, key), a global shuffle. An
    empty table gives an empty mix, and so do weights that are all zero. Columns of ``docs`` named as the two new
    ones are replaced.
    """
    if any(w < 0 or not math.isfinite(w) for w in [*weights.values(), other_weight, size]) or OTHERS in weights:
        raise ValueError(f"weights are finite and not negative, and none is named {OTHERS}")
    rates = repetition_rates(docs, weights, other_weight, source_column, size)
    draw = fresh("_draw", docs.columns)
    copies = F.lit(0)
    source = F.col(source_column).cast("string")

    def inverted(rate: float) -> Column:
        # The number of steps at or below the draw. Few distinct rates: the steps are literals of the plan.
        steps = F.array(*[F.lit(s) for s in poisson_steps(rate)])
        return F.size(F.filter(steps, lambda step: step <= F.col(draw)))

    named = [name for name in rates if name != OTHERS]
    if OTHERS in rates:
        copies = inverted(rates[OTHERS])
    for name in named:
        copies = F.when(source == name, inverted(rates[name])).otherwise(copies)
    base = docs.drop(copy_column, key_column).withColumn(draw, unit_hash(seed, F.col(id_column)))
    drawn = base.withColumn(copy_column, copies).drop(draw).where(F.col(copy_column) > 0)
    copied = drawn.withColumn(copy_column, F.explode(F.sequence(F.lit(1), F.col(copy_column))))
    keyed = copied.withColumn(key_column, unit_hash(seed + "-order", F.col(id_column), F.col(copy_column)))
    dealt = keyed.repartition(key_column) if partitions is None else keyed.repartition(partitions, key_column)
    return dealt.sortWithinPartitions(key_column)


def mixing_sql(table: str, weights: Mapping[str, float], other_weight: float = 1.0, seed: str = "mix", size: float = 1.0) -> str:
    """SQL for the rows of ``mix_sources`` without their order: the columns of ``table``, copy_no, shuffle_key."""
    listed = ", ".join(f"('{name}', {weight!r}::DOUBLE)" for name, weight in weights.items())

    def unit(text: str) -> str:
        return f"('0x' || substr(md5({text}), 1, {HEX_DIGITS}))::BIGINT::DOUBLE / {float(16**HEX_DIGITS)!r}"

    return f"""
    WITH weighted(name, weight) AS (VALUES {listed}),
    grouped AS (
        SELECT d.*, coalesce(w.name, '{OTHERS}') AS grp, coalesce(w.weight, {other_weight!r}::DOUBLE) AS weight
        FROM {table} d LEFT JOIN weighted w ON d.source = w.name
    ), counts AS (
        SELECT grp, any_value(weight) AS weight, count(*) AS n FROM grouped GROUP BY grp
    ), rates AS (
        SELECT grp, {size!r} * sum(n) OVER () * weight / sum(weight) OVER () / n AS rate FROM counts
    ), chances AS (
        SELECT grp, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p
        FROM rates, range(0, 400) AS steps(k) WHERE rate > 0
    ), ladder AS (
        SELECT grp, list(total ORDER BY k) AS totals
        FROM (SELECT grp, k, sum(p) OVER (PARTITION BY grp ORDER BY k) AS total FROM chances) GROUP BY grp
    ), drawn AS (
        SELECT g.*, (SELECT count(*) FROM unnest(l.totals) AS steps(step) WHERE step <= g.draw) AS copies
        FROM (SELECT *, {unit(f"concat('{seed}:', coalesce(doc_id::VARCHAR, 'null'))")} AS draw FROM grouped) g
        JOIN ladder l ON g.grp = l.grp
    ), copied AS (
        SELECT *, unnest(range(1, copies + 1)) AS copy FROM drawn WHERE copies > 0
    )
    SELECT * EXCLUDE (grp, weight, draw, copies, copy), copy::INTEGER AS copy_no,
        {unit(f"concat('{seed}-order:', coalesce(doc_id::VARCHAR, 'null'), ':', copy)")} AS shuffle_key
    FROM copied
    """
