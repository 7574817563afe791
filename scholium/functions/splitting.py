"""Sentences and words of many texts at once, as Arrow arrays inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from scholium.functions.text import SENTENCE_BREAK, WHITE_SPACE

# Documents, and bytes of a text column, that are split together; a longer text is split alone.
STEP_ROWS, STEP_BYTES = 2000, 1 << 22


def steps(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The rows in runs of bounded text (column ``text``)."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = min(start + STEP_ROWS, max(start + 1, int(np.searchsorted(ends, before + STEP_BYTES, side="right"))))
            yield batch.slice(start, end - start)
            start = end


def sentence_rows(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The sentences of all texts as ``text.sentences`` has them, the row of each and its position there."""
    pieces = pc.split_pattern_regex(texts, SENTENCE_BREAK)
    found, owner = pc.utf8_trim(pieces.flatten(), WHITE_SPACE), pc.list_parent_indices(pieces)
    some = pc.not_equal(found, "")
    rows = owner.filter(some).to_numpy().astype(np.int64)
    return found.filter(some), rows, np.arange(len(rows)) - np.searchsorted(rows, rows)


def places_of_words(texts: pa.Array) -> pa.Array:
    """Of each text its distinct words in order, with the position of the sentence of every use."""
    found, row, pos = sentence_rows(texts)
    lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(found), r"\P{L}+", " "))
    words, sentence = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(words), 0)
    coded, sentence = words.filter(some).dictionary_encode(), sentence.filter(some).to_numpy()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    key = row[sentence] * max(1, len(order)) + rank[coded.indices.to_numpy()]
    # Uses come in the order of their sentences, and equal keys keep it.
    by_word = np.argsort(key, kind="stable")
    key = key[by_word]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    owner, word = np.divmod(key[heads], max(1, len(order)))
    places = pa.ListArray.from_arrays(
        pa.array(np.append(heads, len(key)).astype(np.int32)), pa.array(pos[sentence][by_word].astype(np.int32))
    )
    pairs = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(order[word])), places], names=["term", "places"])
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pairs)


def least_of_best(values: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """For each value the ``k``-th largest value of its owner, or the smallest of fewer; ``owner`` is sorted."""
    order = np.lexsort((-values, owner))
    starts = np.searchsorted(owner, owner)
    ends = np.searchsorted(owner, owner, side="right")
    return values[order][np.minimum(starts + k, ends) - 1]
