"""Bounded samples of labelled documents, and the calibration of raw scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Sample:
    """Texts with their label (1 or 0) and a weight that restores the share each label has in all labelled rows."""

    texts: list[str]
    labels: np.ndarray
    weights: np.ndarray


def fold_of(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def first_by_hash(rows: DataFrame, key: str, most: int, total: int) -> DataFrame:
    """``most`` of the ``total`` rows, those whose key has the smallest hashes.

    Only hashes up to a bound that four times as many rows can be expected to meet are sorted, so what tasks send does
    not grow with their number.
    """
    hashed = F.xxhash64(F.col(key).cast("string"))
    share = min(1.0, 4.0 * most / max(1, total))
    near = rows if share == 1.0 else rows.where(hashed < int(-(2**63) + share * 2**64))
    return near.orderBy(hashed, key).limit(most)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_label: int) -> Sample:
    """At most ``per_label`` documents of each label, picked by a hash of the id from all labelled training rows.

    Both tables have ``doc_id``; ``train`` is a condition on it. Rows without a label are left out, and
    ids that carry both labels too. Of an id with several texts the smallest is taken.
    """
    marked = (
        labels.where(train & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).alias("_label"), F.max(label).alias("_most"))
        .where("_label = _most")
        .select("doc_id", "_label")
    )
    totals = {row["_label"]: row["count"] for row in marked.groupBy("_label").count().collect()}
    picks = [
        first_by_hash(marked.where(F.col("_label") == value), "doc_id", per_label, totals.get(value, 0))
        for value in (0, 1)
    ]
    chosen = picks[0].unionByName(picks[1])  # at most 2 * per_label rows
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # One text of each picked id, however many rows repeat it.
    single = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    rows = sorted(single.select("doc_id", "text", "_label").collect())
    y = np.array([row["_label"] for row in rows], dtype=np.int64)
    weights = np.array([totals[v] / max(1, int((y == v).sum())) for v in y], dtype=np.float64)
    return Sample([row["text"] for row in rows], y, weights)


def fit_logistic(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (bias first) of a logistic curve by Newton's method; features are rows of numbers."""
    x = np.hstack([np.ones((len(labels), 1)), features]) if len(labels) else np.zeros((0, 1 + features.shape[1]))
    beta = np.zeros(x.shape[1])
    if not len(labels):
        return beta
    w = weights / weights.mean()
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (labels - p)) - penalty @ beta
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return beta


def logistic(beta: np.ndarray, features: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(beta[0] + features @ beta[1:], -30, 30)))
