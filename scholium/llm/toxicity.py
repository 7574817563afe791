"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Each token is clean or toxic. The field has one weight per hashed token feature (the word, its beginnings and endings)
and weights for the step from one tag to the next. Labels come per document, so the tokens of the training
sample are labelled first: in a toxic document, those that carry the strongest marks of toxic
documents; in a clean one, none. Forward and backward passes run over all documents of a batch side by side. A
document's score is a logistic curve of the expected number of toxic tokens and of the most certain one.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholium.llm.labelled import Sample, fit_logistic, fold_of, labelled_sample, logistic
from scholium.llm.texts import field_type, filled, give_back, schema, slices, task_cache

BUCKETS = 1 << 18
WIDTH = 9  # features per token
PER_LABEL = 3000
WINDOW = 64
TEXT_WINDOWS = 8  # of one document, in training
EPOCHS = 6
CACHE_ENTRIES = 400_000

_PLAIN = re.compile(r"[^\w]+")


def features(token: str) -> list[str]:
    """The word without marks, its beginnings of three to seven letters, its ending and its kind."""
    word = _PLAIN.sub("", token.lower())
    kind = "caps" if token.isupper() else "marks" if len(word) * 2 < len(token) else "plain"
    starts = [f"s{n}={word[:n]}" for n in range(3, 8) if len(word) >= n]
    return [f"w={word}", *starts, f"e4={word[-4:]}", f"k={kind}", "any"]


def _hashed(token: str) -> list[int]:
    """Feature numbers padded to WIDTH with 0, which has no weight."""
    numbers = [1 + zlib.crc32(f.encode()) % (BUCKETS - 1) for f in features(token)]
    return numbers + [0] * (WIDTH - len(numbers))


@dataclass
class ToxicModel:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, dtype=np.float32))
    # Weight of the step from tag i to tag j.
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    beta: np.ndarray = field(default_factory=lambda: np.zeros(3))
    known: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def emission(self, token: str) -> float:
        found = self.known.get(token)
        if found is None:
            found = float(self.weights[_hashed(token)].sum())
            if len(self.known) >= CACHE_ENTRIES:
                self.known.clear()
            self.known[token] = found
        return found

    def marginals(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text, the log odds that each of its tokens is toxic."""
        task_cache("toxicity", self.known.clear)
        known, emission = self.known.get, self.emission
        scores = []
        for text in texts:
            row = []
            for token in text.split():
                e = known(token)
                row.append(emission(token) if e is None else e)
            scores.append(np.array(row))
        return chain_log_odds(scores, self.steps)

    def document_features(self, odds: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(odds), 2))
        for i, o in enumerate(odds):
            expected = (1.0 / (1.0 + np.exp(-np.clip(o, -30, 30)))).sum() if len(o) else 0.0
            out[i] = math.log(expected + 1e-4), min(max(o.max() if len(o) else -15.0, -15.0), 15.0)
        return out


def chain_log_odds(emissions: list[np.ndarray], steps: np.ndarray) -> list[np.ndarray]:
    """Forward-backward for two tags, as log odds. Sequences are walked side by side, the longest first."""
    lengths = np.array([len(e) for e in emissions], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    flat = np.concatenate(emissions) if len(emissions) else np.zeros(0)
    forward, backward = np.empty(len(flat)), np.empty(len(flat))
    first, sizes = starts[order], lengths[order]
    longest = int(sizes[0]) if len(sizes) else 0
    # How many sequences are longer than t.
    live = np.searchsorted(-sizes, -np.arange(longest), side="left") if longest else np.zeros(0, dtype=np.int64)
    state = np.zeros(0)
    for t in range(longest):
        at = first[: live[t]] + t
        if t == 0:
            state = flat[at]
        else:
            x = state[: live[t]]
            state = flat[at] + np.logaddexp(steps[0, 1], steps[1, 1] + x) - np.logaddexp(steps[0, 0], steps[1, 0] + x)
        forward[at] = state
    state = np.zeros(len(sizes))  # log odds of what follows, given the tag
    for t in range(longest - 1, -1, -1):
        n = live[t]
        at = first[:n] + t
        more = live[t + 1] if t + 1 < longest else 0
        x = flat[at[:more] + 1] + backward[at[:more] + 1]
        new = np.zeros(n)
        new[:more] = np.logaddexp(steps[1, 0], steps[1, 1] + x) - np.logaddexp(steps[0, 0], steps[0, 1] + x)
        backward[at] = new
    total = forward + backward
    return [total[s : s + n] for s, n in zip(starts, lengths)]


def _marks(sample: Sample) -> dict[str, float]:
    """Features of words that toxic documents have far more often than clean ones, with how much they explain."""

    def counted(label: int, among: dict[str, int] | None = None) -> Counter:
        seen = Counter()
        for text, y in zip(sample.texts, sample.labels):
            if int(y) == label:
                found = set()
                for token in set(text.split()):
                    found.update(f for f in features(token) if f[0] in "ws" and (among is None or f in among))
                seen.update(found)
        return seen

    # Of clean texts only the features are counted that enough toxic ones have; all others would fill the memory.
    often = {name: count for name, count in counted(1).items() if count >= 3}
    rare = counted(0, often)
    n = {v: max(1, int((sample.labels == v).sum())) for v in (0, 1)}
    strength = {}
    for name, toxic in often.items():
        p, q = toxic / n[1], (rare[name] + 0.5) / (n[0] + 1)
        if p > 8 * q:
            strength[name] = toxic * math.log(p / q)
    return strength


def label_tokens(sample: Sample) -> list[np.ndarray | None]:
    """Token labels of each sampled text; None for a toxic text without any mark."""
    strength = _marks(sample)
    best = {}

    def of(token: str) -> float:
        if token not in best:
            best[token] = max((strength.get(f, 0.0) for f in features(token)), default=0.0)
        return best[token]

    labels: list[np.ndarray | None] = []
    for text, y in zip(sample.texts, sample.labels):
        marks = np.array([of(token) for token in text.split()])
        if not y:
            labels.append(np.zeros(len(marks), dtype=np.int8))
        elif not len(marks) or marks.max() <= 0:
            labels.append(None)
        else:
            labels.append((marks >= 0.5 * marks.max()).astype(np.int8))
    return labels


def _windows(sample: Sample) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training windows: feature numbers (windows, WINDOW, WIDTH), tags (windows, WINDOW; -1 pads), weights."""
    chosen = []
    for text, tags, label, weight in zip(sample.texts, label_tokens(sample), sample.labels, sample.weights):
        if tags is None or not len(tags):
            continue
        tokens = text.split()
        begins = list(range(0, len(tokens), WINDOW))
        if label:
            begins = [b for b in begins if tags[b : b + WINDOW].any()]
        if len(begins) > TEXT_WINDOWS:
            begins = [begins[i * len(begins) // TEXT_WINDOWS] for i in range(TEXT_WINDOWS)]
        chosen += [(tokens[b : b + WINDOW], tags[b : b + WINDOW], 1.0 if label else min(1.0, weight)) for b in begins]
    # Feature numbers go straight into their array, as the driver has little room.
    x = np.zeros((len(chosen), WINDOW, WIDTH), dtype=np.int32)
    y = np.full((len(chosen), WINDOW), -1, dtype=np.int8)
    places: dict[str, tuple[int, int]] = {}
    for i, (part, part_tags, _) in enumerate(chosen):
        y[i, : len(part)] = part_tags
        for t, token in enumerate(part):
            if token in places:
                x[i, t] = x[places[token]]
            else:
                x[i, t], places[token] = _hashed(token), (i, t)
    return x, y, np.array([w for _, _, w in chosen])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _passes(e: np.ndarray, mask: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of padded windows."""
    forward, backward = np.zeros_like(e), np.zeros_like(e)
    forward[:, 0] = e[:, 0]
    for t in range(1, e.shape[1]):
        x = forward[:, t - 1]
        forward[:, t] = e[:, t] + np.logaddexp(steps[0, 1], steps[1, 1] + x) - np.logaddexp(steps[0, 0], steps[1, 0] + x)
    for t in range(e.shape[1] - 2, -1, -1):
        x = e[:, t + 1] + backward[:, t + 1]
        ahead = np.logaddexp(steps[1, 0], steps[1, 1] + x) - np.logaddexp(steps[0, 0], steps[0, 1] + x)
        backward[:, t] = np.where(mask[:, t + 1], ahead, 0.0)
    return forward, backward


def train_chain(sample: Sample, seed: int = 7) -> ToxicModel:
    """Conditional likelihood of the labelled windows, climbed by AdaGrad; features and tag steps together."""
    model = ToxicModel()
    x, y, w = _windows(sample)
    weights, steps = np.zeros(BUCKETS), np.zeros((2, 2))
    squares, step_squares = np.full(BUCKETS, 1e-8), np.full((2, 2), 1e-8)
    random = np.random.default_rng(seed)
    for _ in range(EPOCHS if len(x) else 0):
        for batch in np.array_split(random.permutation(len(x)), max(1, len(x) // 256)):
            bx, by, bw = x[batch], y[batch], w[batch][:, None]
            mask = by >= 0
            e = weights[bx].sum(2)
            forward, backward = _passes(e, mask, steps)
            gap = np.where(mask, bw * (by - _sigmoid(forward + backward)), 0.0)
            gradient = np.bincount(bx.ravel(), np.repeat(gap.ravel(), WIDTH), BUCKETS) / len(batch)
            gradient[0] = 0.0
            pairs = _pair_gap(by, mask, bw, e, forward, backward, steps) / len(batch)
            squares += gradient**2
            weights += 0.3 * gradient / np.sqrt(squares)
            step_squares += pairs**2
            steps += 0.1 * pairs / np.sqrt(step_squares)
    model.weights, model.steps = weights.astype(np.float32), steps
    model.beta = fit_logistic(model.document_features(model.marginals(sample.texts)), sample.labels, sample.weights)
    return model


def _pair_gap(tags, mask, weight, e, forward, backward, steps) -> np.ndarray:
    """Tag pairs seen in the labels less those the field expects."""
    both = mask[:, 1:]
    p = _sigmoid(forward + backward)[:, :-1]
    ahead = e[:, 1:] + backward[:, 1:]
    gap = np.zeros((2, 2))
    for i, share in ((0, 1.0 - p), (1, p)):
        to_one = _sigmoid(steps[i, 1] - steps[i, 0] + ahead)
        for j, q in ((0, 1.0 - to_one), (1, to_one)):
            seen = (tags[:, :-1] == i) & (tags[:, 1:] == j)
            gap[i, j] = (weight * np.where(both, seen - share * q, 0.0)).sum()
    return gap


def train_toxicity(docs: DataFrame, labels: DataFrame, train: Column, per_label: int = PER_LABEL) -> ToxicModel:
    """The field of at most ``per_label`` documents of each label, picked by a hash of the id.

    At most ``TEXT_WINDOWS`` windows of a document are learned from, spread over its length: of a toxic one among those with a marked
    token. Null and unknown labels are left out; without labels every score is one half.
    """
    return train_chain(labelled_sample(docs, labels, "toxic", train, per_label))


SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("probability", T.DoubleType())]
    )
)
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))


def toxic_spans(text: str, odds: np.ndarray) -> list[dict]:
    """Runs of tokens that are toxic rather than clean, as code point offsets, with the least odds of each run."""
    if not len(odds) or odds.max() <= 0:
        return []
    spans: list[dict] = []
    last, position = None, 0
    for i, token in enumerate(text.split()):
        start = text.index(token, position)
        position = start + len(token)
        if odds[i] <= 0:
            continue
        p = float(_sigmoid(odds[i]))
        if last == i - 1 and spans:
            spans[-1]["end"] = position
            spans[-1]["probability"] = min(spans[-1]["probability"], p)
        else:
            spans.append({"start": start, "end": position, "probability": p})
        last = i
    return spans


def score_toxicity(docs: DataFrame, model: ToxicModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``score`` (0 to 1, higher is more toxic) and ``spans``.

    Null and empty texts have no tokens, hence no spans, and the lowest score there is. Repeated rows and null ids stay, very long texts
    are tagged whole. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights
    out = schema((id_column, field_type(rows, "_id")), ("score", "double"), ("spans", SPANS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = filled(batch.column(1)).to_pylist()
            odds = shared.value.marginals(texts)
            scores = logistic(shared.value.beta, shared.value.document_features(odds))
            spans = pa.array([toxic_spans(t, o) for t, o in zip(texts, odds)], _ARROW_SPANS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), spans], names=out.names)

    return rows.mapInArrow(run, out)


def toxicity_of(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted, spans; labels of the fold ``held_out`` are never read."""
    model = train_toxicity(docs, labels, fold_of("doc_id", folds) != held_out)
    return score_toxicity(docs, model).select(
        "doc_id",
        (fold_of("doc_id", folds) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "spans",
    )


def drop_toxic(docs: DataFrame, model: ToxicModel, threshold: float, text_column: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay, whatever their names.

    Null and empty texts are scored like texts without tokens; repeated rows are judged alike.
    """
    own = schema(*[(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])
    at = docs.columns.index(text_column)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            odds = shared.value.marginals(filled(batch.column(at)).to_pylist())
            scores = logistic(shared.value.beta, shared.value.document_features(odds))
            clean = pa.array(scores < threshold)
            yield pa.RecordBatch.from_arrays([column.filter(clean) for column in batch.columns], names=own.names)
        give_back()

    kept = docs.mapInArrow(run, own)
    return kept.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)])
