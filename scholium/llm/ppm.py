"""Scores of texts under two language models learned from the whole corpus: words, and prediction by partial matching.

The byte model is a context trie of depth ``ORDER``. A byte is coded in the longest context that has been seen; a byte
that is new there costs an escape and is coded one order lower, without the bytes that the longer context would have
coded (symbol exclusion). Escapes are estimated by the number of different bytes of a context (method C). The text is
scored with A-Z lower-cased, followed by an end mark, a byte that UTF-8 does not use.

The word model is add-one-tenth over all words of the corpus. Neither its table nor that of the grams has a bound.
Documents are dealt into blocks of bounded size; every block asks for its own words and grams once, and the counts of
the words and the probabilities of the grams come back to the block. The table of all grams stays in Spark, dealt by
the last two bytes of the context: whoever holds all grams of such a pair can sum up every order from two on, and
the counts of byte pairs, at most 65,536, are sent to all for the lower ones.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.labelled import fold_of
from scholium.llm.texts import field_type, filled, lean, lean_batches, schema
from scholium.plans import scratch_dir

ORDER = 5
END = 0xFF
PAD = bytes([END] * ORDER)
_BYTE = np.uint64(8)
STEP_BYTES = 1 << 21  # text that is turned into grams at a time
SCORE_BYTES = 1 << 18  # the same for looking grams up, which takes some hundred bytes for each
BLOCK_BYTES = 1 << 24
PART_GRAMS = 100_000  # distinct grams from which a task computes probabilities at a time, unless byte pairs have more
LEAST_BUCKETS = 64
HELD_GRAMS = 1_000_000  # grams a task holds unsorted
WORD_ENTRIES = 800_000  # (block, word) pairs a task holds before it sends them on


def _steps(texts: list[bytes], most: int | None = None) -> Iterator[list[bytes]]:
    step, size = [], 0
    for text in texts:
        step.append(text)
        size += len(text)
        if size >= (STEP_BYTES if most is None else most):
            yield step
            step, size = [], 0
    if step:
        yield step


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every byte of the texts, end marks included, behind its context; with begin and end of each text."""
    data = np.frombuffer(b"".join(PAD + t + PAD[:1] for t in texts), np.uint8).astype(np.uint64)
    grams = np.zeros(len(data) - ORDER, np.uint64)
    for k in range(ORDER + 1):
        grams = grams << _BYTE | data[k : len(data) - ORDER + k]
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes + ORDER) - ORDER
    return grams, ends - sizes, ends


def _tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum the counts of equal keys; keys come out sorted."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[heads], np.add.reduceat(counts, heads)


def _count(steps: Iterator[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all texts, sorted, with their counts."""
    keys, counts, parts = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    for step in steps:
        grams, begins, ends = _grams(step)
        inside = np.ones(len(grams), bool)
        for k in range(ORDER):
            inside[ends[:-1] + k] = False  # what lies between two texts belongs to neither
        parts.append(np.unique(grams[inside], return_counts=True))
        if sum(len(p[0]) for p in parts) > HELD_GRAMS:
            keys, counts = _tally(np.concatenate([keys, *[p[0] for p in parts]]), np.concatenate([counts, *[p[1] for p in parts]]))
            parts = []
    return _tally(np.concatenate([keys, *[p[0] for p in parts]]), np.concatenate([counts, *[p[1] for p in parts]]))


def count_grams(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """gram (long), n (long): how often each byte followed each context, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowered = ([t.encode().lower() for t in filled(batch.column(0)).to_pylist()] for batch in batches)
        keys, counts = _count(step for texts in lowered for step in _steps(texts))
        for i in range(0, len(keys), 200_000):
            columns = [pa.array(keys[i : i + 200_000].astype(np.int64)), pa.array(counts[i : i + 200_000].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "n"])

    texts = docs.select(F.col(text_column).cast("string").alias("_text"))
    partial = texts.mapInArrow(run, schema(("gram", "long"), ("n", "long")))
    return partial.groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class HashTable:
    """Numbers by 64-bit key, with open addressing; all lookups of an array at once."""

    keys: np.ndarray
    values: np.ndarray
    filled: np.ndarray
    bits: int

    @staticmethod
    def build(keys: np.ndarray, values: np.ndarray) -> HashTable:
        bits = max(4, int(2 * len(keys)).bit_length())
        size = 1 << bits
        table = HashTable(np.zeros(size, np.uint64), np.zeros(size, values.dtype), np.zeros(size, bool), bits)
        keys = keys.astype(np.uint64)
        left, slot = np.arange(len(keys)), table._slots(keys)
        while len(left):
            free = ~table.filled[slot]
            # Of keys that meet in a free slot the last one written gets it.
            table.keys[slot[free]] = keys[left[free]]
            table.filled[slot[free]] = True
            won = free & (table.keys[slot] == keys[left])
            table.values[slot[won]] = values[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & (size - 1)
        return table

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it is missing."""
        found = np.full(len(keys), -1, np.int64)
        at, slot = np.arange(len(keys)), self._slots(keys)
        while len(at):
            here = self.keys[slot] == keys[at]
            full = self.filled[slot]
            hit = here & full
            found[at[hit]] = slot[hit]
            go = full & ~here
            at, slot = at[go], (slot[go] + 1) & (len(self.keys) - 1)
        return found

    def values_of(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; not a number where it is missing, as what lies between two texts is."""
        slot = self.find(keys)
        return np.where(slot >= 0, self.values[slot], np.nan)


class Trie:
    """The byte model, from the counts of its deepest grams.

    With ``pairs``, the counts of each byte (column) after each byte (row) of the whole corpus, the grams may be those
    of some last two context bytes only, as long as they are all grams of these.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray | None = None):
        order = np.argsort(grams)
        grams, counts = grams[order].astype(np.uint64), counts[order].astype(np.float64)
        # Level d holds contexts of d bytes: grams of d + 1 bytes, counts, and per context its total and variety.
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {ORDER: (grams, counts)}
        for d in range(ORDER - 1, -1, -1):
            keys, n = self.tables[d + 1]
            self.tables[d] = _tally(keys & np.uint64((1 << 8 * (d + 1)) - 1), n)
            if d == 1 and pairs is not None:
                seen = np.flatnonzero(pairs)
                self.tables[d] = seen.astype(np.uint64), pairs.ravel()[seen].astype(np.float64)
        self.contexts = {d: self._contexts(d) for d in range(1, ORDER + 1)}
        keys, n = self.tables[0]
        self.flat = np.zeros(256)
        self.flat[keys] = n
        self._compile()
        del self.tables, self.contexts

    def _contexts(self, d: int) -> dict[str, np.ndarray]:
        keys, n = self.tables[d]
        context = keys >> _BYTE
        heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, int)
        sums = (lambda x: np.add.reduceat(x, heads)) if len(heads) else (lambda x: np.zeros(0))
        lower_keys, lower_n = self.tables[d - 1]
        below = keys & np.uint64((1 << 8 * d) - 1)
        # What the bytes seen in this context count for one order lower: left out after an escape.
        shadow = lower_n[np.searchsorted(lower_keys, below)] if len(keys) else np.zeros(0)
        return {"key": context[heads], "total": sums(n), "variety": sums(np.ones(len(n))), "shadow": sums(shadow)}

    def _compile(self) -> None:
        """Hash tables: of the deepest grams their log10 in their own context, of the other orders their counts."""
        self.levels = {}
        for d in range(1, ORDER + 1):
            c = self.contexts[d]
            rows = np.stack([c["total"], c["variety"], c["shadow"]], axis=1)
            self.levels[d] = (HashTable.build(c["key"], np.arange(len(c["key"]))), rows)
        self.counts = {d: HashTable.build(*self.tables[d]) for d in range(1, ORDER)}
        keys, n = self.tables[ORDER]
        c = self.contexts[ORDER]
        at = np.searchsorted(c["key"], keys >> _BYTE)
        self.direct = HashTable.build(keys, np.log10(n / (c["total"][at] + c["variety"][at])) if len(keys) else n)

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the bytes before it."""
        slot = self.direct.find(grams)
        out = np.where(slot >= 0, self.direct.values[slot], 0.0)
        new = np.flatnonzero(slot < 0)
        if len(new):
            out[new] = self._escaped(grams[new])
        return out

    def _escaped(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams))
        open_ = np.arange(len(grams))
        # Count and variety of the bytes that a longer context has ruled out, in the terms of the next order.
        gone, gone_kinds = np.zeros(len(grams)), np.zeros(len(grams))
        for d in range(ORDER, 0, -1):
            contexts, rows = self.levels[d]
            keys = grams[open_] & np.uint64((1 << 8 * (d + 1)) - 1)
            slot = contexts.find(keys >> _BYTE)
            seen = slot >= 0
            row = rows[contexts.values[slot[seen]]]
            at = open_[seen]
            total, kinds = row[:, 0] - gone[at], row[:, 1] - gone_kinds[at]
            # Deepest grams that are known do not come here. Elsewhere a known byte is never one that is ruled out:
            # a longer context that had seen it would have coded it.
            hit = self.counts[d].find(keys[seen]) if d < ORDER else np.full(len(at), -1)
            inside = hit >= 0
            some = total > 0
            scale = np.where(some, total + kinds, 1.0)
            if inside.any():
                out[at[inside]] += np.log10(self.counts[d].values[hit[inside]] / scale[inside])
            missed = ~inside
            # With nothing left in the context the escape is certain.
            cost = np.where(some, kinds, 1.0) / scale
            out[at[missed]] += np.log10(cost[missed])
            gone[at[missed]], gone_kinds[at[missed]] = row[missed, 2], row[missed, 1]
            open_ = np.concatenate([open_[~seen], at[missed]])
        byte = (grams[open_] & np.uint64(0xFF)).astype(np.int64)
        kinds_left = (self.flat > 0).sum() - gone_kinds[open_]
        total_left = self.flat.sum() - gone[open_]
        some = total_left > 0
        scale = np.where(some, total_left + kinds_left, 1.0)
        inside = self.flat[byte] > 0
        known = self.flat[byte] / scale
        unseen = max(1, 256 - int((self.flat > 0).sum()))
        new = np.where(some, kinds_left, 1.0) / scale / unseen
        out[open_] += np.log10(np.where(inside, known, new))
        return out


def text_scores(texts: list[bytes], log10: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """log10 of the probability of each whole text with its end, from that of its grams."""
    out = []
    for step in _steps(texts, SCORE_BYTES):
        grams, begins, ends = _grams(step)
        bounds = np.stack([begins, ends], axis=1).ravel()
        logs = np.append(log10(grams), 0.0)
        out.append(np.add.reduceat(logs, bounds)[::2])
    return np.concatenate(out) if out else np.zeros(0)


def learn_grams(docs: DataFrame, text_column: str = "text", capacity: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The deepest grams with their counts, from all rows, on the driver; with ``capacity`` only the most frequent.

    For a ``Trie`` of a small corpus in one place. ``score_corpus`` does not use it.
    """
    table = count_grams(docs, text_column)
    if capacity is not None:
        table = table.orderBy(F.desc("n"), "gram").limit(capacity)
    rows = table.toArrow()
    return rows.column("gram").to_numpy().astype(np.uint64), rows.column("n").to_numpy().astype(np.int64)


def _pack(numbers: np.ndarray) -> bytes:
    """64-bit numbers with equal bytes of all of them together, compressed."""
    return zlib.compress(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()


def _pack_sorted(numbers: np.ndarray) -> bytes:
    return _pack(np.diff(numbers, prepend=np.uint64(0)))


def _unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack(packed), dtype=np.uint64)


def _bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % buckets


def _block_grams(blocked: DataFrame, buckets: int) -> DataFrame:
    """_block, _bucket, _grams, _counts: the grams of each block, packed by a hash, with their counts in its training rows."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        lowered = [t.encode().lower() for t in rows.column("_text").to_pylist()]
        learn = rows.column("_learn").to_pylist()
        keys, counts = _count(_steps([t for t, x in zip(lowered, learn) if x]))
        others, _ = _count(_steps([t for t, x in zip(lowered, learn) if not x]))
        keys, counts = _tally(np.concatenate([keys, others]), np.concatenate([counts, np.zeros(len(others), np.int64)]))
        bucket = _bucket_of(keys, buckets)
        order = np.argsort(bucket, kind="stable")
        names, begins = np.unique(bucket[order], return_index=True)
        slices = np.split(order, begins[1:])
        return pa.table(
            {
                "_block": pa.array([key[0].as_py()] * len(names), pa.int32()),
                "_bucket": pa.array(names, pa.int32()),
                "_grams": pa.array([_pack_sorted(keys[at]) for at in slices], pa.binary()),
                "_counts": pa.array([_pack(counts[at]) for at in slices], pa.binary()),
            }
        )

    kinds = schema(("_block", "int"), ("_bucket", "int"), ("_grams", "binary"), ("_counts", "binary"))
    return blocked.select("_block", "_learn", "_text").groupBy("_block").applyInArrow(lambda key, rows: lean(run, key, rows), kinds)


def _sum_grams(asked: DataFrame) -> DataFrame:
    """gram, n: every gram of the corpus once, with its count in all training rows (0 where only held-out rows have it)."""

    def run(rows: pa.Table) -> pa.Table:
        keys = np.concatenate([_unpack_sorted(p) for p in rows.column("_grams").to_pylist()])
        counts = np.concatenate([_unpack(p).astype(np.int64) for p in rows.column("_counts").to_pylist()])
        keys, counts = _tally(keys, counts)
        return pa.table({"gram": pa.array(keys.astype(np.int64)), "n": pa.array(counts)})

    kinds = schema(("gram", "long"), ("n", "long"))
    return asked.select("_bucket", "_grams", "_counts").groupBy("_bucket").applyInArrow(lambda rows: lean(run, rows), kinds)


def _gram_logs(table: DataFrame, parts: int, buckets: int, shared) -> DataFrame:
    """_bucket, gram, log: of every gram the log10 of the probability of its last byte after the others."""

    def run(rows: pa.Table) -> pa.Table:
        grams, n = rows.column("gram").to_numpy().astype(np.uint64), rows.column("n").to_numpy()
        logs = Trie(grams[n > 0], n[n > 0], shared.value).log10(grams)
        return pa.table({"_bucket": pa.array(_bucket_of(grams, buckets), pa.int32()), "gram": pa.array(grams.astype(np.int64)), "log": pa.array(logs)})

    pair = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))
    part = F.pmod(F.xxhash64(pair), F.lit(parts)).alias("_part")
    kinds = schema(("_bucket", "int"), ("gram", "long"), ("log", "double"))
    return table.select(part, "gram", "n").groupBy("_part").applyInArrow(lambda rows: lean(run, rows), kinds)


def _answers(asked: DataFrame, logs: DataFrame) -> DataFrame:
    """_block, _grams, _logs: what each block asked for, with the log10 of each gram."""

    def run(wanted: pa.Table, known: pa.Table) -> pa.Table:
        keys, values = known.column("gram").to_numpy().astype(np.uint64), known.column("log").to_numpy()
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        found = [values[np.searchsorted(keys, _unpack_sorted(p))].tobytes() for p in wanted.column("_grams").to_pylist()]
        return pa.table([wanted.column("_block"), wanted.column("_grams"), pa.array(found, pa.binary())], names=["_block", "_grams", "_logs"])

    kinds = schema(("_block", "int"), ("_grams", "binary"), ("_logs", "binary"))
    both = asked.select("_block", "_bucket", "_grams").groupBy("_bucket").cogroup(logs.groupBy("_bucket"))
    return both.applyInArrow(lambda wanted, known: lean(run, wanted, known), kinds)


def _block_words(blocked: DataFrame) -> DataFrame:
    """_word, _block, _n: the words of each block, with how often its training rows have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[bytes, int]] = defaultdict(dict)
        for batch in batches:
            for block, learn, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                words, add = held[block], int(learn)
                for word in text.encode().lower().split():
                    words[word] = words.get(word, 0) + add
            if sum(map(len, held.values())) > WORD_ENTRIES:
                yield from send(held)
                held.clear()
        yield from send(held)

    def send(held: dict[int, dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        for block, words in held.items():
            names, counts = list(words), list(words.values())
            for i in range(0, len(names), 100_000):
                part = names[i : i + 100_000]
                columns = [pa.array(part, pa.binary()), pa.array([block] * len(part), pa.int32()), pa.array(counts[i : i + 100_000], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["_word", "_block", "_n"])

    kinds = schema(("_word", "binary"), ("_block", "int"), ("_n", "long"))
    return blocked.mapInArrow(lambda batches: lean_batches(run, batches), kinds)


def score_corpus(
    docs: DataFrame, folds: int, held_out: int, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Both models learn from the rows outside the fold ``held_out``; a null id counts as the empty text when it is
    dealt a fold. Null and empty texts consist of the end only. Without any training row the word model gives every
    token one chance in one, and the byte model knows no context. Repeated rows count and are scored each.
    """
    spark = docs.sparkSession
    is_held = fold_of("_id", folds) == held_out
    rows = docs.select(
        F.col(id_column).alias("_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("_text")
    )
    sizes = rows.agg(F.sum(F.octet_length("_text")), F.sum(F.when(is_held, 0).otherwise(1))).first()
    blocks, train_rows = max(1, -(-(sizes[0] or 0) // BLOCK_BYTES)), sizes[1] or 0
    block = F.pmod(F.xxhash64("_id", F.octet_length("_text")), F.lit(blocks)).cast("int")
    blocked = rows.select(block.alias("_block"), (~is_held).alias("_learn"), "_id", "_text").repartition("_block")
    buckets = max(LEAST_BUCKETS, 2 * blocks)
    path = scratch_dir(spark, "asked")
    _block_grams(blocked, buckets).write.parquet(path)
    asked = spark.read.parquet(path)
    path = scratch_dir(spark, "grams")
    _sum_grams(asked).write.parquet(path)
    grams = spark.read.parquet(path)
    last_two = F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("pair")
    ends = grams.groupBy(last_two).agg(F.sum("n").alias("n"), F.count("*").alias("grams")).collect()  # at most 65,536 rows
    pairs = np.zeros((256, 256))
    pairs.ravel()[[row["pair"] for row in ends]] = [row["n"] for row in ends]
    parts = max(LEAST_BUCKETS, -(-sum(row["grams"] for row in ends) // PART_GRAMS))
    gram_logs = _answers(asked, _gram_logs(grams, parts, buckets, spark.sparkContext.broadcast(pairs)))
    path = scratch_dir(spark, "words")
    # A word has at most one row per block here, whatever its frequency.
    by_word = _block_words(blocked).groupBy("_word").agg(F.sum("_n").alias("_c"), F.collect_set("_block").alias("_blocks"))
    by_word.write.parquet(path)
    words = spark.read.parquet(path)
    n, distinct = words.agg(F.sum("_c"), F.count(F.when(F.col("_c") > 0, 1))).first()
    n, distinct = (n or 0) + train_rows, distinct + (train_rows > 0)
    norm = math.log10(n + 0.1 * (distinct + 1))
    end_log = math.log10(train_rows + 0.1)
    wanted = words.select(F.explode("_blocks").alias("_block"), "_word", "_c").unionByName(gram_logs, allowMissingColumns=True)
    id_type = field_type(rows, "_id")
    out = schema(
        (id_column, id_type), ("held_out", "boolean"), ("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"),
        ("base_score", "double"), ("score", "double"),
    )

    def score(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        counts, grams = wanted.filter(pc.is_valid(wanted.column("_word"))), wanted.filter(pc.is_valid(wanted.column("_grams")))
        keys = np.concatenate([_unpack_sorted(p) for p in grams.column("_grams").to_pylist()])
        byte_logs = HashTable.build(keys, np.concatenate([np.frombuffer(p) for p in grams.column("_logs").to_pylist()]))
        logs = np.log10(counts.column("_c").to_numpy() + 0.1)
        of = dict(zip(counts.column("_word").to_pylist(), logs.tolist()))
        lowered = [t.encode().lower() for t in texts.column("_text").to_pylist()]
        n_tokens, n_known, base = [], [], []
        for text in lowered:
            values = np.array([of[w] for w in text.split()])
            n_tokens.append(len(values) + 1)
            n_known.append(int((values > 0).sum()) + (train_rows > 0))
            base.append(float(values.sum()) + end_log - n_tokens[-1] * norm)
        return pa.table(
            [
                texts.column("_id").combine_chunks(),
                pa.array([not v for v in texts.column("_learn").to_pylist()], pa.bool_()),
                pa.array(n_tokens, pa.int64()),
                pa.array(n_known, pa.int64()),
                pa.array([n] * len(lowered), pa.int64()),
                pa.array(base, pa.float64()),
                pa.array(text_scores(lowered, byte_logs.values_of), pa.float64()),
            ],
            names=out.names,
        )

    both = blocked.groupBy("_block").cogroup(wanted.groupBy("_block"))
    return both.applyInArrow(lambda texts, wanted: lean(score, texts, wanted), out)
