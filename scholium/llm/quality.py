"""Quality by compression: which of two dictionaries makes a text smaller.

One zstandard dictionary is built from labelled good text and one from labelled bad text. Whole texts are compressed
with each, piece by piece so that a long text does not end up as its own dictionary. The difference of the two sizes,
divided by the plain size, is turned into a probability by a logistic curve that is fitted on labelled texts no
dictionary was built from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.llm.labelled import fit_logistic, fold_of, labelled_sample, logistic
from scholium.llm.texts import field_type, filled, schema

PIECE_BYTES = 1024
DICTIONARY_BYTES = 1 << 15
LEVEL = 3
PER_LABEL = 3000


def _pieces(text: str) -> list[bytes]:
    raw = text.encode()
    return [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]


def build_dictionary(texts: list[str]) -> bytes:
    """A dictionary of the texts; from few texts, their own last bytes."""
    pieces = [p for text in texts for p in _pieces(text) if len(p) > 8]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if data is not None:
        data.precompute_compress(level=LEVEL)
    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    return zstandard.ZstdCompressor(dict_data=data, **plain) if data else zstandard.ZstdCompressor(level=LEVEL, **plain)


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    beta: np.ndarray

    def differences(self, texts: list[str]) -> np.ndarray:
        """(size with the bad dictionary - size with the good one) / plain size; 0 for an empty text."""
        good, bad = _compressor(self.good).compress, _compressor(self.bad).compress
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            pieces = _pieces(text)
            if pieces:
                out[i] = sum(len(bad(p)) - len(good(p)) for p in pieces) / sum(map(len, pieces))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return logistic(self.beta, self.differences(texts)[:, None] * 100)


def train_quality(docs: DataFrame, labels: DataFrame, train: Column, per_label: int = PER_LABEL) -> QualityModel:
    """Two thirds of a bounded sample build the dictionaries, one third fits the curve.

    With fewer than six texts of a label the whole sample does both, as there is nothing to hold back. Texts too few or too
    short to train a dictionary from are one themselves, up to its size from their end. At most ``per_label`` documents of each
    label are learned from; null and unknown labels are left out, and without labels every score is the same.
    """
    sample = labelled_sample(docs, labels, "quality", train, per_label)
    turn = np.arange(len(sample.texts)) % 3
    if min((sample.labels == 0).sum(), (sample.labels == 1).sum()) < 6:
        turn = np.full(len(sample.texts), -1)  # too few to hold any back
    built = {v: [t for t, y, k in zip(sample.texts, sample.labels, turn) if y == v and k < 2] for v in (0, 1)}
    model = QualityModel(build_dictionary(built[1]), build_dictionary(built[0]), np.zeros(2))
    fit = (turn == 2) | (turn < 0)
    texts = [t for t, f in zip(sample.texts, fit) if f]
    model.beta = fit_logistic(model.differences(texts)[:, None] * 100, sample.labels[fit], sample.weights[fit])
    return model


def score_quality(docs: DataFrame, model: QualityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and ``score`` (0 to 1, higher is better).

    Null and empty texts get the score of a text that neither dictionary prefers. Repeated rows and null ids stay, very long texts
    are compressed whole, piece by piece. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(filled(batch.column(1)).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[id_column, "score"])

    return rows.mapInArrow(run, schema((id_column, field_type(rows, "_id")), ("score", "double")))


def quality_of(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of the fold ``held_out`` are never read."""
    model = train_quality(docs, labels, fold_of("doc_id", folds) != held_out)
    return score_quality(docs, model).select(
        "doc_id",
        (fold_of("doc_id", folds) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
