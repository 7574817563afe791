"""The operators bound to the test tables, each beside the SQL that gives the same rows."""

from scholium.bindings import content, feeds, goals, activity, progress, rows, search, streams  # noqa: F401
from scholium.bindings.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
