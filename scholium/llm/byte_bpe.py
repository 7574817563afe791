"""Byte-level BPE encoding and decoding with a queue of merge ranks.

The tokens of a word form a linked list. Every pair of neighbours whose joined bytes are a token waits in the bucket of
that token's rank, at the position where the pair begins. Which buckets have entries is kept as a bitmap under a bitmap
of its words, so two find-first-set steps give the lowest rank, whatever the length of the word. A merge changes
at most two pairs; what they leave in other buckets is stale and skipped when it comes up. The words of a slice of
texts lie one behind the other in the same list, without pairs between them, so one run of the queue merges them all. Its
cost is that of sorting the entries, also where one word is megabytes long.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.texts import field_type, filled, schema, slices, task_cache

WORD_BITS = 8
WORD_MASK = (1 << WORD_BITS) - 1
# Text whose words are merged together, and bytes of words and ids a task remembers before it starts again.
ENCODE_BYTES = 1 << 21
CACHE_BYTES, ENTRY_BYTES = 1 << 26, 180
# The longest word a task remembers.
CACHE_WORD = 128
# Texts with more characters are split and ids are decoded so many at a time.
LONG_TEXT, DECODE_IDS = 1 << 20, 1 << 20


class RankQueue:
    """Positions by rank, handed out one rank after the other, the lowest first."""

    def __init__(self, ranks: int):
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.words = [0] * (-(-ranks >> WORD_BITS))
        self.top = 0

    def push(self, rank: int, *positions: int) -> None:
        bucket = self.buckets[rank]
        if not bucket:
            place = rank >> WORD_BITS
            self.words[place] |= 1 << (rank & WORD_MASK)
            self.top |= 1 << place
        bucket.extend(positions)

    def take(self) -> tuple[int, list[int]] | None:
        """The lowest rank with entries and its positions in order; its bucket is empty then."""
        if not self.top:
            return None
        place = (self.top & -self.top).bit_length() - 1
        word = self.words[place]
        first = word & -word
        self.words[place] = word ^ first
        if word == first:
            self.top &= self.top - 1
        rank = place << WORD_BITS | first.bit_length() - 1
        positions, self.buckets[rank] = self.buckets[rank], []
        positions.sort()
        return rank, positions


class ByteBpe:
    """A file of ranks as encoder and decoder of texts. Every single byte must have a rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no rank for the bytes {missing[:5]}")
        self.ranks = ranks
        self.labels = [b""] * (max(ranks.values()) + 1)
        self.singles = np.array([ranks[bytes([b])] for b in range(256)])
        # Ranks of two bytes, by both; -1 where these are no token.
        self.doubles = np.full(1 << 16, -1)
        for token, rank in ranks.items():
            self.labels[rank] = token
            if len(token) == 2:
                self.doubles[token[0] << 8 | token[1]] = rank
        self.queue = RankQueue(len(self.labels))
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers.

        In every word, of all pairs the one of lowest rank is merged, the leftmost first, until none is left.
        """
        text, rank_of, queue = b"".join(words), self.ranks.get, self.queue
        push, size = queue.push, len(text)
        starts = np.cumsum([0, *map(len, words)])
        raw = np.frombuffer(text, np.uint8).astype(np.int64)
        pairs = np.full(size, -1)
        pairs[:-1] = self.doubles[raw[:-1] << 8 | raw[1:]]
        pairs[starts[1:] - 1] = -1  # the last byte of a word
        order = np.argsort(pairs, kind="stable")
        filled, firsts = np.unique(pairs[order], return_index=True)
        places = order.tolist()
        for rank, a, b in zip(filled.tolist(), firsts.tolist(), [*firsts[1:].tolist(), size]):
            if rank >= 0:
                push(rank, *places[a:b])
        # Of a token that begins at i: its id, the rank of the pair it begins, where it ends (there the next begins) and where
        # the one before it begins, below zero for the first of a word.
        token, pair, end = self.singles[raw].tolist(), pairs.tolist(), list(range(1, size + 1))
        links = np.arange(-1, size)
        links[starts] = -1
        before, alive = links.tolist(), bytearray(b"\1" * size)
        while (taken := queue.take()) is not None:
            rank, positions = taken
            for at, i in enumerate(positions):
                if pair[i] != rank:
                    continue
                j = end[i]
                stop = end[i] = end[j]
                token[i] = rank
                alive[j] = 0
                pair[i] = pair[j] = -1
                lowest = rank
                if before[stop] >= 0:
                    before[stop] = i
                    joined = rank_of(text[i : end[stop]])
                    if joined is not None:
                        pair[i] = joined
                        push(joined, i)
                        lowest = joined
                last = before[i]
                if last >= 0:
                    joined = rank_of(text[last:stop])
                    if joined is None:
                        pair[last] = -1
                    else:
                        pair[last] = joined
                        push(joined, last)
                        if joined < lowest:
                            lowest = joined
                if lowest < rank:
                    # A pair came up that goes first.
                    if at + 1 < len(positions):
                        push(rank, *positions[at + 1 :])
                    break
        left = np.flatnonzero(np.frombuffer(alive, np.uint8))
        ids = np.array(token)[left].astype("<u4").tobytes()
        bounds = (np.searchsorted(left, starts) * 4).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def _learn(self, words: set[str]) -> None:
        """Remember the ids of these words."""
        missing = [word for word in words if word not in self.known]
        pieces = [word.encode() for word in missing]
        whole = [self.ranks.get(piece) for piece in pieces]
        parts = iter(self.merged([piece for piece, rank in zip(pieces, whole) if rank is None]) if None in whole else ())
        for word, piece, rank in zip(missing, pieces, whole):
            found = next(parts) if rank is None else rank.to_bytes(4, "little")
            self.known[word] = found
            self.held += len(piece) + len(found) + ENTRY_BYTES

    def _split(self, text: str) -> Iterator[list[str]]:
        """The words of a long text in several lists."""
        words, held = [], 0
        for match in self.pattern.finditer(text):
            words.append(match.group())
            held += len(words[-1])
            if held >= LONG_TEXT:
                yield words
                words, held = [], 0
        yield words

    def _joined(self, lists: list[list[str]]) -> list[bytes]:
        """Ids of lists of words."""
        if self.held >= CACHE_BYTES:
            self.known.clear()
            self.held = 0
        words = set().union(*lists)
        self._learn(words)
        known = self.known
        ids = [b"".join([known[word] for word in words_]) for words_ in lists]
        for word in words:
            if len(word) > CACHE_WORD:
                self.held -= len(word.encode()) + len(known.pop(word)) + ENTRY_BYTES
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        short = [i for i, text in enumerate(texts) if len(text) <= LONG_TEXT]
        ids = dict(zip(short, self._joined([self.pattern.findall(texts[i]) for i in short])))
        for i, text in enumerate(texts):
            if i not in ids:
                ids[i] = b"".join([self._joined([words])[0] for words in self._split(text)])
        return [ids[i] for i in range(len(texts))]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the tokens; an unknown id is an error."""
        numbers = np.frombuffer(ids, "<u4")
        parts = [numbers[i : i + DECODE_IDS].tolist() for i in range(0, len(numbers), DECODE_IDS)]
        return b"".join(b"".join(map(self.labels.__getitem__, part)) for part in parts)


_loaded: dict[str, ByteBpe] = {}


def _vocabulary(ranks: bytes, pattern: str) -> ByteBpe:
    """Read once per Python worker."""
    task_cache("byte_bpe", _loaded.clear)
    key = hashlib.sha256(ranks).hexdigest() + pattern
    if key not in _loaded:
        _loaded.clear()
        lines = map(bytes.split, filter(None, ranks.splitlines()))
        _loaded[key] = ByteBpe({base64.b64decode(token): int(rank) for token, rank in lines}, pattern)
    return _loaded[key]


def read_ranks(path: str) -> bytes:
    """A file of ranks; only the driver reads it."""
    with open(path, "rb") as file:
        return file.read()


def encode_bytes(
    docs: DataFrame,
    ranks: bytes,
    pattern: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    outputs: tuple[str, ...] = ("ids", "decoded"),
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens`` and the ``outputs`` asked for.

    Outputs are ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` (binary, the bytes these ids stand
    for). ``ranks`` is the text of the rank file (base64 token and rank per line), which is broadcast: its size is bounded
    by its token count. ``pattern`` says where texts are split; what it leaves out is dropped, as in the usual library.
    Null and empty texts have no tokens and decode to nothing. Repeated rows and null ids are kept. Very long texts are read word by
    word, and a word may be as long as its text. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    out = schema((id_column, field_type(rows, "_id")), ("n_tokens", "long"), *[(name, "binary") for name in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _vocabulary(shared.value, pattern)
        for batch in slices(batches, 1, ENCODE_BYTES):
            ids = bpe.encode(filled(batch.column(1)).to_pylist())
            made = {"ids": ids, "decoded": map(bpe.decode, ids) if "decoded" in outputs else ()}
            counts = pa.array([len(i) // 4 for i in ids], pa.int64())
            columns = [pa.array(list(made[name]), pa.binary()) for name in outputs]
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, *columns], names=out.names)

    return rows.mapInArrow(run, out)


def decode_bytes(encoded: DataFrame, ranks: bytes, pattern: str, ids_column: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its token ids (binary, as ``encode_bytes`` gives them) stand for; null ids give none."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("binary")
    def decoded(ids):
        bpe = _vocabulary(shared.value, pattern)
        return ids.map(lambda row: b"" if row is None else bpe.decode(bytes(row)))

    return encoded.withColumn(into, decoded(F.col(ids_column)))
