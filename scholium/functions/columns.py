"""Small column expressions used by screens and by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shown when a name is missing, and the first value not counted on a badge.
MISSING_NAME = "Student"
BADGE_CAP = 9
# Marks of the first three places, and of the places after them.
MEDALS = {1: "🥇", 2: "🥈", 3: "🥉"}
OTHER_MEDAL = "⭐"

ColumnOrName = Column | str


def as_column(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def initials(name: ColumnOrName, n: int = 2, missing: str = MISSING_NAME) -> Column:
    """Upper-case first letters of the first ``n`` space-separated parts (empty parts count)."""
    parts = F.slice(F.split(F.coalesce(as_column(name), F.lit(missing)), " "), 1, n)
    return F.array_join(F.transform(parts, lambda part: F.upper(F.substring(part, 1, 1))), "")


def clamp_pct(value: ColumnOrName) -> Column:
    """Limit to 0..100; missing counts as 0, not-a-number stays unknown."""
    number = as_column(value).cast("double")
    bounded = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(number, F.lit(0.0))))
    return F.when(~F.isnan(F.coalesce(number, F.lit(0.0))), bounded)


def capped_count(count: ColumnOrName, cap: int = BADGE_CAP) -> Column:
    """Badge text: ``9+`` above the cap, the number itself, or null when there is nothing to show."""
    number = as_column(count)
    return F.when(number > cap, F.lit(f"{cap}+")).when(number > 0, number.cast("string"))


def default_if_blank(value: ColumnOrName, default: str) -> Column:
    """``default`` for null and for the empty string; white space is kept."""
    return F.coalesce(F.nullif(as_column(value), F.lit("")), F.lit(default))


def present(*values: ColumnOrName) -> Column:
    """True when every value is neither null nor the empty string."""
    tests = [F.coalesce(as_column(value) != "", F.lit(False)) for value in values]
    return reduce(lambda left, right: left & right, tests)


def first_or(values: ColumnOrName, default: str) -> Column:
    """First element of an array, or the default when there is none or it is empty."""
    return default_if_blank(F.get(as_column(values), F.lit(0)), default)


def score_label(correct: ColumnOrName, total: ColumnOrName) -> Column:
    """``9/10``; null when either part is."""
    return F.concat(as_column(correct).cast("string"), F.lit("/"), as_column(total).cast("string"))


def rank_label(rank: ColumnOrName) -> Column:
    return F.concat(F.lit("#"), as_column(rank).cast("string"))


def lookup(key: ColumnOrName, mapping: Mapping[Any, Any], default: Any) -> Column:
    """Value of ``key`` in a small fixed mapping, else the default."""
    entries = F.create_map(*[F.lit(item) for pair in mapping.items() for item in pair])
    return F.coalesce(F.try_element_at(entries, as_column(key)), F.lit(default))


def medal(rank: ColumnOrName) -> Column:
    return lookup(as_column(rank).cast("int"), MEDALS, OTHER_MEDAL)


def flag(value: ColumnOrName, expected: Any) -> Column:
    """Equality that is false, never null, for a missing value."""
    return as_column(value).eqNullSafe(F.lit(expected))


def case_label(cases: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """Label of the first condition that holds."""
    label = reduce(
        lambda chain, case: chain.when(case[0], F.lit(case[1])),
        cases[1:],
        F.when(cases[0][0], F.lit(cases[0][1])),
    )
    return label.otherwise(F.lit(otherwise))


def parse_score(text: ColumnOrName) -> Column:
    """``"9/10"`` as a struct of correct and total; parts that are no numbers become null."""
    parts = F.split(as_column(text), "/")
    part = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("bigint")
    return F.struct(part(0).alias("correct"), part(1).alias("total"))


def percent(part: ColumnOrName, whole: ColumnOrName, digits: int = 4) -> Column:
    """100 * part / whole, null when the whole is zero or missing."""
    whole = as_column(whole)
    return F.round(F.try_divide(100.0 * as_column(part), whole.cast("double")), digits)


def compact_number(n: ColumnOrName) -> Column:
    """``950``, ``20K+``, ``1M+``, ``3B+``: whole thousands, millions or billions, rounded down."""
    number = as_column(n).cast("bigint")

    def scaled(unit: int, suffix: str) -> Column:
        return F.concat(F.floor(number / unit).cast("string"), F.lit(suffix))

    return (
        F.when(number >= 1_000_000_000, scaled(1_000_000_000, "B+"))
        .when(number >= 1_000_000, scaled(1_000_000, "M+"))
        .when(number >= 1_000, scaled(1_000, "K+"))
        .otherwise(number.cast("string"))
    )
