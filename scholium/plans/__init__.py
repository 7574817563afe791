"""Plan building blocks that keep jobs even when one key holds a large share of the rows."""

from scholium.plans.durable import cut_lineage, scratch_dir, written
from scholium.plans.positions import lead_in_order, number_rows
from scholium.plans.skew import (
    SHARES,
    collect_bounded,
    fill_from,
    is_small,
    salted_join,
    split_frequent,
    top_per_key,
    weighted_lookup,
)

__all__ = [
    "SHARES",
    "collect_bounded",
    "cut_lineage",
    "fill_from",
    "is_small",
    "lead_in_order",
    "number_rows",
    "salted_join",
    "scratch_dir",
    "split_frequent",
    "top_per_key",
    "weighted_lookup",
    "written",
]
