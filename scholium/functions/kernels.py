"""Array work inside one task: keep the best k scores per query while batches go by."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def id_array(ids) -> np.ndarray:
    """Ids of a batch in a form that sorts: numbers, or texts of fixed width."""
    values = ids.to_numpy(zero_copy_only=False) if isinstance(ids, pa.Array) else ids.to_numpy()
    return values.astype(str) if values.dtype == object else values


class BestPerQuery:
    """The ``k`` highest scores per query seen so far; equal scores go to the lower id.

    Ids are numbers or texts, of one kind.
    """

    def __init__(self, k: int, digits: int):
        self.k = k
        self.digits = digits
        self.queries = np.empty(0, dtype=np.int64)
        self.ids: np.ndarray | None = None
        self.scores = np.empty(0, dtype=np.float64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take a (rows, queries) matrix of scores; not-a-number means no match."""
        rounded = np.round(scores, self.digits)
        if len(ids) > self.k:
            ranked = np.where(np.isnan(rounded), -np.inf, rounded)
            floor = np.partition(ranked, len(ids) - self.k, axis=0)[len(ids) - self.k]
            keep = (rounded >= floor) & ~np.isnan(rounded)
        else:
            keep = ~np.isnan(rounded)
        row, query = np.nonzero(keep)
        queries = np.concatenate([self.queries, query])
        all_ids = ids[row] if self.ids is None else np.concatenate([self.ids, ids[row]])
        all_scores = np.concatenate([self.scores, rounded[row, query]])
        order = np.lexsort((all_ids, -all_scores, queries))
        queries = queries[order]
        starts = np.searchsorted(queries, queries, side="left")
        best = order[np.arange(len(order)) - starts < self.k]
        self.queries = np.concatenate([self.queries, query])[best]
        self.ids, self.scores = all_ids[best], all_scores[best]


class BestAbove:
    """The ``k`` highest scores per query, of queries that are offered one by one and must reach a floor.

    The floor rises to the k-th best score seen. Equal scores go to the lower id.
    """

    def __init__(self, k: int, queries: int, floors: np.ndarray | None = None):
        self.k = k
        self.floors = np.full(queries, -np.inf) if floors is None else floors.copy()
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def offer(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        high = scores >= self.floors[query]
        ids, scores = ids[high], scores[high]
        if query in self.held:
            held_ids, held = self.held[query]
            ids, scores = np.concatenate([held_ids, ids]), np.concatenate([held, scores])
        order = np.lexsort((ids, -scores))[: self.k]
        if len(order):
            self.held[query] = ids[order], scores[order]
            if len(order) == self.k:
                self.floors[query] = max(self.floors[query], scores[order[-1]])

    def columns(self, names: list) -> tuple[list, list, list]:
        """Query names, ids and scores, row by row."""
        queries = [names[q] for q, (ids, _) in self.held.items() for _ in ids]
        ids = [i for found, _ in self.held.values() for i in found.tolist()]
        return queries, ids, [s for _, found in self.held.values() for s in found.tolist()]


def floors_of(rows: list, numbers: dict, k: int) -> np.ndarray:
    """The k-th best score of each query in (query, id, score) rows; none where there are fewer."""
    by_query: dict = {}
    for query, _, score in rows:
        by_query.setdefault(query, []).append(score)
    floors = np.full(len(numbers), -np.inf)
    for query, scores in by_query.items():
        if len(scores) >= k:
            floors[numbers[query]] = sorted(scores, reverse=True)[k - 1]
    return floors


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero vector has no direction and becomes not-a-number."""
    lengths = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return vectors / lengths
