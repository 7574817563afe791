"""All documents whose word shingles overlap enough, exactly, as links and as components.

A document's set holds the hashes of its distinct five-word shingles. Documents with the same set are one class.

1. A class can only have a partner if three quarters of its shingles occur in another class too. Tasks send
   the shingles of many documents together, cut into ranges of the hash; a range says which of them are shared. Classes
   with too few shared shingles leave here. That is nearly all of them, and no pair has been looked at.
2. Most linked sets share one of their smallest hashes. Each class is compared with a few leaders of those that do.
   Large groups of near copies become one component this way, without a pair of each two.
3. All linked sets share one of the first quarter of each ("prefix") in any common order; rare hashes come first. What
   is left are prefix hashes whose classes lie in different components. They are compared in tiles: classes of
   like size, at most ``TILE`` by ``TILE`` of them, with hashed bitmaps of their sets. The bits in which two bitmaps
   differ bound the overlap from above; pairs that may still be linked are decided by intersecting the sorted hashes. A
   pair that shares several hashes comes up at the first of them, as far as ``LEAD`` hashes of each class tell.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholium.llm.components import components
from scholium.llm.texts import arrow_rows, drop_caches, field_type, filled, lean, lean_batches, schema, slices, written
from scholium.plans.skew import SHARES

WORDS = 5
PERCENT = 75
STEP_BYTES = 1 << 22  # text whose shingles travel together
STEP_DOCS = 60_000
NAME_BYTES = 8  # of a set's name, to tell classes apart while shingles are counted
RANGE_SHINGLES = 1 << 22  # shingles of one hash range, about
FIRST = 8  # smallest hashes by which classes meet leaders
LEADERS, STAR_ROUNDS = 4, 3
# Hashes that more classes have than COMMON stand at the end of the order, at most the MOST_COMMON of them by count.
COMMON, MOST_COMMON = 4, 200_000
TILE = 256
SMALL_TILE = 16  # tiles up to this size are compared together
SLICE_ROWS = 512  # rows whose sets a task has in memory at a time
LEAST_RANGE_BITS = 6
# First tokens of a class that tell whether a pair has met before.
LEAD = 32

_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(WORDS)], dtype=np.uint64)


def _slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows bounded in number and in the bytes of column ``at``."""
    drop_caches()
    for batch in slices(batches, at):
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def _written(df: DataFrame, name: str) -> DataFrame:
    """``written`` where tasks take texts or whole sets, a slice of rows at a time."""
    with arrow_rows(df.sparkSession, SLICE_ROWS):
        return written(df, name)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its five-word shingles; of fewer words, one of the whole sequence."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, owners = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(words), 0)
    owner = pc.filter(owners, some).to_numpy()
    # Every word of the batch is hashed once.
    coded = pc.filter(words, some).dictionary_encode()
    known = coded.dictionary.cast(pa.binary()).to_pylist()
    table = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
    hashes = table[coded.indices.to_numpy()]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    count = max(0, len(hashes) - WORDS + 1)
    total = np.zeros(count, dtype=np.uint64)
    for k in range(WORDS):
        total += hashes[k : k + count] * _MULTIPLIERS[k]
    total = _mixed(total)
    sets = []
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if end - start >= WORDS:
            found = np.sort(total[start : end - WORDS + 1])
            sets.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
            continue
        few = hashes[start:end]
        if len(few):
            few = _mixed(np.array([(few * _MULTIPLIERS[: len(few)]).sum(dtype=np.uint64) + np.uint64(len(few))], dtype=np.uint64))
        sets.append(few)
    return sets


def shingle_set(text: str) -> np.ndarray:
    return shingle_sets(pa.array([text]))[0]


def set_name(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def prefix_size(n: int) -> int:
    """How many of the smallest hashes hold one of any set that is linked with a set of ``n``."""
    return n - -(-n * PERCENT // 100) + 1


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Parity of the hashes per bit, as 64-bit words; four times as many bits as the power of two from the set's size on.

    So few hashes meet in a bit that the bound is close where sets are similar.
    """
    bits = max(64, 4 << max(0, int(len(hashes) - 1).bit_length()))
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, count: int) -> np.ndarray:
    """A bitmap of ``count`` words from a longer one: parities add up."""
    while len(words) > count:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def may_link(n: int, m: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether the overlap, at most (n + m - differing bits) / 2, can make 75 percent of the union."""
    overlap = (n + m - apart) // 2
    return 100 * overlap >= PERCENT * (n + m - overlap)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """The exact test on sorted hashes, behind the bound by bitmaps."""
    n, m = len(x), len(y)
    if 100 * min(n, m) < PERCENT * max(n, m):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= PERCENT * (n + m - common)


def _named_sets(rows: DataFrame) -> DataFrame:
    """_id, _set (null without words), _n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1):
            sets = shingle_sets(filled(batch.column(1)))
            names = pa.array([set_name(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), names, pa.array(list(map(len, sets)), pa.int64())], names=out.names)

    out = schema(("_id", field_type(rows, "_id")), ("_set", "binary"), ("_n", "long"))
    return rows.mapInArrow(lambda batches: lean_batches(run, batches), out)


def _ranges(rows: DataFrame, bits: int) -> DataFrame:
    """Shingles of many documents together, by hash range.

    Of each class that a step of texts has in a range: the first bytes of its name, its count of shingles that are
    shared within the step, and its count of shingles that no other class of the step has. These follow class by
    class, as the 32 bits of their hash behind the range; then the shared ones, once each.
    """
    out = schema(("_range", "int"), ("names", "binary"), ("own", "binary"), ("sizes", "binary"), ("alone", "binary"), ("shared", "binary"))

    def send(step: dict[bytes, np.ndarray]) -> Iterator[pa.RecordBatch]:
        names, sets = np.array([int.from_bytes(n[:NAME_BYTES], "big") for n in step], np.uint64), list(step.values())
        hashes = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        single = new & np.concatenate([new[1:], [True]])
        bounds = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1)) if bits else np.array([0, len(hashes)])
        rest = ((hashes >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        columns: list[list] = [[], [], [], [], [], []]
        for k in range(1 << bits):
            part = slice(bounds[k], bounds[k + 1])
            if part.start == part.stop:
                continue
            present, local = np.unique(owner[part], return_inverse=True)
            alone = single[part]
            own = np.bincount(local[~alone], minlength=len(present)).astype(np.int32)
            sizes = np.bincount(local[alone], minlength=len(present)).astype(np.int32)
            by_class = np.argsort(local[alone], kind="stable")
            values = (k, names[present], own, sizes, rest[part][alone][by_class], rest[part][~alone & new[part]])
            for column, value in zip(columns, values):
                column.append(value if column is columns[0] else value.tobytes())
        kinds = [pa.int32(), *[pa.binary()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step: dict[bytes, np.ndarray] = {}
        size = 0
        for batch in _slices(batches, 1):
            texts = filled(batch.column(1))
            for hashes, length in zip(shingle_sets(texts), pc.binary_length(texts).to_pylist()):
                if not len(hashes):
                    continue
                step[set_name(hashes)] = hashes
                size += length
                if size >= STEP_BYTES or len(step) >= STEP_DOCS:
                    yield from send(step)
                    step, size = {}, 0
        if step:
            yield from send(step)

    return rows.mapInArrow(lambda batches: lean_batches(run, batches), out)


def _shared_counts(ranges: DataFrame) -> DataFrame:
    """_name, _shared: at least the number of its shingles that another class has, in parts to be added up.

    Shingles of a range are told apart by 32 more bits of their hash and classes by the first bytes of their name,
    so a count may be too high but never too low.
    """
    out = schema(("_name", "long"), ("_shared", "long"))

    def count(table: pa.Table) -> pa.Table:
        alone = [np.frombuffer(b, np.uint32) for b in table.column("alone").to_pylist()]
        alls = np.sort(np.concatenate([*alone, *[np.frombuffer(b, np.uint32) for b in table.column("shared").to_pylist()]]))
        twice = np.unique(alls[1:][alls[1:] == alls[:-1]])
        # Shared within one step and alone in another is met twice too.
        names, counts = [], []
        for rest, name, own, sizes in zip(alone, *[table.column(c).to_pylist() for c in ("names", "own", "sizes")]):
            again = np.zeros(len(rest), bool)
            if len(twice):
                again = twice[np.minimum(np.searchsorted(twice, rest), len(twice) - 1)] == rest
            sizes = np.frombuffer(sizes, np.int32)
            local = np.repeat(np.arange(len(sizes)), sizes)
            total = np.frombuffer(own, np.int32) + np.bincount(local[again], minlength=len(sizes))
            some = np.flatnonzero(total)
            names.append(np.frombuffer(name, np.int64)[some])
            counts.append(total[some])
        return pa.table([pa.array(np.concatenate(names)), pa.array(np.concatenate(counts).astype(np.int64))], names=out.names)

    return ranges.groupBy("_range").applyInArrow(lambda table: lean(count, table), out)


def _sets_of(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """cid, _set, n, hashes, bits of the wanted classes, from one document of each."""
    out = schema(("_set", "binary"), ("hashes", "binary"), ("bits", "binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1):
            names, hashes, bits = [], [], []
            for wanted, found in zip(batch.column(0).to_pylist(), shingle_sets(filled(batch.column(1)))):
                if len(found) and set_name(found) == wanted:  # an id may stand for several texts
                    names.append(wanted)
                    hashes.append(found.tobytes())
                    bits.append(bitmap(found).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (names, hashes, bits)], names=out.names)

    texts = rows.withColumn("_h", F.xxhash64("_id")).join(owners.select("_h", "_set"), "_h").select("_set", "_text")
    found = texts.mapInArrow(lambda batches: lean_batches(run, batches), out)
    once = found.groupBy("_set").agg(F.first("hashes").alias("hashes"), F.first("bits").alias("bits"))
    numbered = once.select(F.monotonically_increasing_id().alias("cid"), "_set", "hashes", "bits")
    return _written(numbered.withColumn("n", (F.length("hashes") / 8).cast("long")), "sets")


def _common_hashes(sets: DataFrame) -> np.ndarray:
    """The hashes that most classes have, the rarest first; of bounded number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 0):
            raw = b"".join(batch.column(0).to_pylist())
            tokens, counts = np.unique(np.frombuffer(raw, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(counts)], names=["token", "count"])

    kinds = schema(("token", "long"), ("count", "long"))
    partial = sets.select("hashes").mapInArrow(lambda batches: lean_batches(run, batches), kinds)
    counts = partial.groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") > COMMON)
    rows = counts.orderBy(F.desc("count"), "token").limit(MOST_COMMON).toArrow()
    return rows.column("token").to_numpy()[::-1].copy()


def _prefixes(sets: DataFrame) -> DataFrame:
    """cid, token, at: the prefix of each class, in the common order."""
    common = _common_hashes(sets)
    shared = sets.sparkSession.sparkContext.broadcast((np.sort(common), np.argsort(common, kind="stable")))
    out = schema(("cid", "long"), ("token", "long"), ("at", "int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, places = shared.value
        for batch in _slices(batches, 1):
            parts: list[list[np.ndarray]] = [[], [], []]
            for cid, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = np.frombuffer(raw, np.int64)
                place = np.full(len(hashes), -1)
                if len(tokens):
                    where = np.minimum(np.searchsorted(tokens, hashes), len(tokens) - 1)
                    found = tokens[where] == hashes
                    place[found] = places[where[found]]
                # Rare hashes in their own order, then the common ones in theirs.
                first = hashes[np.lexsort((hashes, place))][: prefix_size(len(hashes))]
                for part, values in zip(parts, (np.full(len(first), cid), first, np.arange(len(first), dtype=np.int32))):
                    part.append(values)
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], names=out.names)

    return sets.select("cid", "hashes").mapInArrow(lambda batches: lean_batches(run, batches), out)


def _smallest(sets: DataFrame) -> DataFrame:
    """cid, token: the FIRST smallest hashes of each class."""
    out = schema(("cid", "long"), ("token", "long"))
    most = FIRST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1):
            firsts = [np.frombuffer(raw, np.int64)[:most] for raw in batch.column(1).to_pylist()]
            cids = np.repeat(batch.column(0).to_numpy(), [len(f) for f in firsts])
            tokens = np.concatenate([np.zeros(0, np.int64), *firsts])
            yield pa.RecordBatch.from_arrays([pa.array(cids), pa.array(tokens)], names=out.names)

    return sets.select("cid", "hashes").mapInArrow(lambda batches: lean_batches(run, batches), out)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked: first by size and bitmap, then by intersection. ``a`` may repeat often."""
    small = sets.select("cid", "n", "bits")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 4):
            keep = []
            for n, m, x, y in zip(*[batch.column(i).to_pylist() for i in range(2, 6)]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                width = min(len(x), len(y))
                apart = int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum())
                keep.append(bool(may_link(n, np.int64(m), apart)))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 2):
            sides = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            mask = pa.array([linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in sides], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    def side(table: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
        return table.select(F.col("cid").alias(key), *[F.col(old).alias(new) for old, new in names.items()])

    with_b = pairs.join(side(small, "b", {"n": "m", "bits": "y"}), "b")
    with_a = with_b.join(side(small, "a", {"n": "n", "bits": "x"}), "a").where(
        (100 * F.least("n", "m") >= PERCENT * F.greatest("n", "m"))
    )
    out = schema(("a", "long"), ("b", "long"))
    likely = with_a.select("a", "b", "n", "m", "x", "y").mapInArrow(lambda batches: lean_batches(bounded, batches), out)
    arrays = likely.join(side(sets, "b", {"hashes": "y"}), "b").join(side(sets, "a", {"hashes": "x"}), "a")
    return arrays.select("a", "b", "x", "y").mapInArrow(lambda batches: lean_batches(exact, batches), out)


def _star_pairs(first: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Classes beside LEADERS of those that share one of their smallest hashes and are in other components yet.

    Leaders are picked by a hash that changes with every turn, so a class that is like some of a group soon meets one.
    """
    placed = first.join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    member = F.struct("comp", "cid")
    picks = [F.min_by(member, F.xxhash64("cid", F.lit(LEADERS * turn + k))) for k in range(LEADERS)]
    groups = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.array(*picks).alias("leads"))
    leads = groups.where("lo < hi").select("token", F.explode(F.array_distinct("leads")).alias("lead"))
    beside = placed.join(leads, "token").where(F.col("comp") != F.col("lead.comp"))
    pair = [F.least("cid", "lead.cid").alias("a"), F.greatest("cid", "lead.cid").alias("b")]
    return beside.select(*pair).distinct()


def _tile_pairs(prefixes: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a prefix hash and that size and bitmap let pass."""
    placed = prefixes.join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    spread = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    open_ = placed.join(spread.select("token"), "token", "left_semi").select("cid", "token", "comp", "at")
    # The first tokens of each class, in the common order, that it may share with others.
    leads = open_.groupBy("cid").agg(F.slice(F.sort_array(F.collect_list(F.struct("at", "token"))), 1, LEAD).alias("_lead"))
    leads = leads.select("cid", F.col("_lead.token").alias("lead"))
    band = F.floor(F.log("n") / math.log(100 / PERCENT) + 1e-9).cast("int")
    sized = open_.drop("at").join(sets.select("cid", "n"), "cid").withColumn("_band", band)
    # A class stands in its own band and in the next one, so neighbours meet once at least.
    banded = written(sized.withColumn("band", F.explode(F.array("_band", F.col("_band") + 1))).drop("_band"), "banded")
    counts = banded.groupBy("token", "band").agg(F.count("*").alias("rows"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    counts = counts.where("lo < hi").select("token", "band", F.ceil(F.col("rows") / TILE).cast("int").alias("sides"))
    sided = banded.join(counts, ["token", "band"]).join(sets.select("cid", "bits").join(leads, "cid"), "cid")
    side = F.pmod(F.xxhash64("cid"), F.col("sides")).cast("int")
    # Each class meets every side of its group: tile (i, j) holds side i and side j.
    dealt = sided.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    keys = ["token", "band", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")]
    tiles = dealt.select(*keys, "cid", "comp", "n", "bits", "lead").repartition("token", "band", "i", "j")
    tiles = tiles.sortWithinPartitions("token", "band", "i", "j")
    out = schema(("a", "long"), ("b", "long"))
    most = LEAD

    def compared(tile: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        cid, comp, n = (tile.column(c).to_numpy() for c in ("cid", "comp", "n"))
        bitmaps = [np.frombuffer(b, np.uint64) for b in tile.column("bits").to_pylist()]
        width = min(map(len, bitmaps))
        bits = np.stack([folded(b, width) for b in bitmaps])
        token = tile.column("token")[0].as_py()
        leads = np.stack([np.pad(np.array(x, np.int64), (0, most - len(x)), constant_values=token) for x in tile.column("lead").to_pylist()])
        a, b = [], []
        for k in range(len(cid) - 1):
            rest = slice(k + 1, None)
            apart = np.bitwise_count(bits[rest] ^ bits[k]).sum(axis=1, dtype=np.int64)
            sizes = 100 * np.minimum(n[rest], n[k]) >= PERCENT * np.maximum(n[rest], n[k])
            hit = np.flatnonzero((comp[rest] != comp[k]) & sizes & may_link(int(n[k]), n[rest], apart)) + k + 1
            # Tokens stand in one order everywhere: those before this one, if both have one of them, brought the pair up already.
            earlier = leads[k][: np.argmax(leads[k] == token) if (leads[k] == token).any() else most]
            hit = hit[~np.isin(leads[hit], earlier).any(axis=1)]
            a.append(np.minimum(cid[hit], cid[k]))
            b.append(np.maximum(cid[hit], cid[k]))
        return np.concatenate(a), np.concatenate(b)

    def compared_together(table: pa.Table, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for many small tiles: neighbours in one tile, pair by pair, with bitmaps as numbers."""
        cid, comp, n, token = (table.column(c).to_numpy() for c in ("cid", "comp", "n", "token"))
        raw, leads = table.column("bits"), table.column("lead")
        firsts, seconds = [], []
        for away in range(1, SMALL_TILE):
            k = np.flatnonzero((tile[:-away] == tile[away:]) & (comp[:-away] != comp[away:]))
            like = 100 * np.minimum(n[k], n[k + away]) >= PERCENT * np.maximum(n[k], n[k + away])
            firsts.append(k[like])
            seconds.append(k[like] + away)
        a, b = [], []
        numbers: dict[int, tuple[int, int]] = {}

        def number(row: int) -> tuple[int, int]:
            if row not in numbers:
                value = raw[row].as_py()
                numbers[row] = int.from_bytes(value, "little"), 8 * len(value)
            return numbers[row]

        for x, y in zip(np.concatenate([[], *firsts]).astype(int).tolist(), np.concatenate([[], *seconds]).astype(int).tolist()):
            (p, wide), (q, other) = number(x), number(y)
            while wide > other:
                wide //= 2
                p = (p >> wide) ^ (p & ((1 << wide) - 1))
            while other > wide:
                other //= 2
                q = (q >> other) ^ (q & ((1 << other) - 1))
            if not may_link(int(n[x]), n[y], (p ^ q).bit_count()):
                continue
            lead = leads[x].as_py()
            earlier = lead[: lead.index(token[x])] if token[x] in lead else lead
            if set(earlier).isdisjoint(leads[y].as_py()):
                a.append(min(cid[x], cid[y]))
                b.append(max(cid[x], cid[y]))
        return np.array(a, np.int64), np.array(b, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
            """The pairs of all tiles of ``table`` but the last, which may go on, and that one."""
            key = np.stack([table.column(c).to_numpy() for c in ("token", "band", "i", "j")])
            heads = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
            ends = [*heads[1:], table.num_rows]
            whole = len(heads) if last else len(heads) - 1
            sizes = np.diff([*heads, table.num_rows])
            found = [compared(table.slice(h, e - h)) for h, e, size in zip(heads[:whole], ends[:whole], sizes) if size > SMALL_TILE]
            few = np.repeat(np.where(sizes <= SMALL_TILE, np.arange(len(heads)), -1), sizes)
            few[heads[whole] if whole < len(heads) else table.num_rows :] = -1
            chosen = np.flatnonzero(few >= 0)
            if len(chosen) > 1:
                found.append(compared_together(table.take(pa.array(chosen)).combine_chunks(), few[chosen]))
            a, b = (np.concatenate([np.zeros(0, np.int64), *[f[i] for f in found]]) for i in (0, 1))
            both = np.unique(np.stack([a, b]), axis=1)
            rest = table.slice(heads[whole]) if whole < len(heads) else table.slice(table.num_rows)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=out.names), rest

        for batch in batches:
            if batch.num_rows:
                done, rest = pairs(pa.Table.from_batches([*held, batch]).combine_chunks(), last=False)
                held = rest.to_batches()
                yield done
        if held:
            yield pairs(pa.Table.from_batches(held).combine_chunks(), last=True)[0]

    return tiles.mapInArrow(lambda batches: lean_batches(run, batches), out).distinct()


def _grouped(rows: DataFrame) -> DataFrame:
    """_id, _set, _n and a struct _part (group, name) of each row: its component and the smallest id in it."""
    members = _written(_named_sets(rows), "members")
    classes = written(
        members.where("_set is not null")
        .groupBy("_set")
        .agg(F.first("_n").alias("n"), F.min("_id").alias("least_id"), F.min(F.xxhash64("_id")).alias("_h"), F.count("*").alias("copies")),
        "classes",
    )
    count, total = members.agg(F.count("*"), F.sum("_n")).first()
    bits = max(LEAST_RANGE_BITS, int((total or 0) // RANGE_SHINGLES).bit_length())
    shared = _shared_counts(_ranges(rows, bits)).groupBy("_name").agg(F.sum("_shared").alias("shared"))
    name = F.conv(F.hex(F.substring("_set", 1, NAME_BYTES)), 16, -10).cast("long")
    wanted = classes.withColumn("_name", name).join(shared, "_name").where(100 * F.col("shared") >= PERCENT * F.col("n")).select("_set", "_h")
    sets = _sets_of(rows, wanted)
    labels = _link_classes(sets)
    numbers = sets.select("cid", "_set").join(labels, "cid").select("_set", "comp")
    placed = classes.join(numbers, "_set", "left")
    names = placed.where("comp is not null").groupBy("comp").agg(F.min("least_id").alias("name"), F.min("_set").alias("group"))
    part = F.struct(F.coalesce("group", "_set").alias("group"), F.coalesce("name", "least_id").alias("name"))
    named = written(placed.join(names, "comp", "left").select("_set", "copies", part.alias("_part")), "named")
    # Rows of very frequent sets look their component up by broadcast; there are at most SHARES such sets.
    often = F.col("copies") >= max(2, count / SHARES)
    hot = F.broadcast(named.where(often).select("_set", F.col("_part").alias("_hot")))
    cold = named.where(~often).select(F.col("_set").alias("_probe"), F.col("_part").alias("_cold"))
    asks = F.col("_hot").isNull() & F.col("_set").isNotNull()
    probe = F.when(asks, F.col("_set")).otherwise(F.unhex(F.hex(F.xxhash64("_id"))))
    found = members.join(hot, "_set", "left").withColumn("_probe", probe).join(cold, "_probe", "left")
    return found.select("_id", "_set", "_n", F.coalesce("_hot", "_cold").alias("_part"))


def similar_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id.

    ``component_id`` is the smallest id that links reach, the own one included. Null, empty and blank texts have no
    shingles and are linked with nothing. A null id is never a component's name while another id is there. Repeated
    rows stay, other columns are not read, an empty table gives no rows.
    """
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"))
    component = F.when(F.col("_set").isNull(), F.col("_id")).otherwise(F.col("_part.name"))
    return _grouped(rows).select(
        F.col("_id").alias(id_column), F.col("_n").alias("n_shingles"), component.alias("component_id")
    )


def drop_similar(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id, and every row without shingles.

    All columns stay. Where rows repeat an id within a component one of them stays.
    """
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"))
    grouped = _grouped(rows).where("_set is not null")
    kept = (
        grouped.where(F.col("_id").eqNullSafe(F.col("_part.name")))
        .groupBy("_part.group")
        .agg(F.min(F.struct("_set", F.xxhash64("_id").alias("_h"))).alias("_keep"))
        .select("_keep._set", "_keep._h", F.lit(True).alias("_kept"))
    )
    own = schema(*[(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)], ("_set", "binary"))
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, at):
            sets = shingle_sets(filled(batch.column(at)))
            names = pa.array([set_name(s) if len(s) else b"" for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, names], names=own.names)

    key = f"c{docs.columns.index(id_column)}"
    marked = docs.mapInArrow(lambda batches: lean_batches(run, batches), own)
    marked = marked.withColumn("_h", F.xxhash64(key)).withColumn("_row", F.monotonically_increasing_id())
    joined = marked.join(kept, ["_set", "_h"], "left").where(F.col("_kept") | (F.length("_set") == 0))
    order = F.row_number().over(Window.partitionBy("_set", "_h", F.when(F.col("_kept").isNull(), F.col("_row"))).orderBy("_row"))
    single = joined.withColumn("_order", order).where("_order = 1")
    return single.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)])


def _link_classes(sets: DataFrame) -> DataFrame:
    """cid, comp for all classes with links."""
    spark = sets.sparkSession
    prefixes = _written(_prefixes(sets), "prefixes")
    first = _written(_smallest(sets), "smallest")
    labels = spark.createDataFrame([], schema(("cid", "long"), ("comp", "long")))
    links = tried = spark.createDataFrame([], schema(("a", "long"), ("b", "long")))
    for turn in range(STAR_ROUNDS):
        pairs = written(_star_pairs(first, labels, turn).join(tried, ["a", "b"], "left_anti"), "pairs")
        more = _written(_verified(pairs, sets), "verified")
        if more.isEmpty():
            break
        links, tried = links.unionByName(more), tried.unionByName(pairs)
        labels = components(links).withColumnRenamed("node", "cid")
    left = _tile_pairs(prefixes, labels, sets).join(tried, ["a", "b"], "left_anti")
    more = _written(_verified(written(left, "pairs"), sets), "verified")
    if more.isEmpty():
        return labels
    return components(links.unionByName(more)).withColumnRenamed("node", "cid")
