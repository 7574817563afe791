import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from scholium.llm import ppm
from scholium.llm.ppm import ORDER, PAD, HashTable, Trie, learn_grams, score_corpus
from scholium.llm.queries import LLM_QUERIES
from tests.llm.frames import FOLDER, ROWS, clashing, documents


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 10 == 0


class Plain:
    """Prediction by partial matching with one dictionary per context."""

    def __init__(self, texts):
        self.seen = [defaultdict(Counter) for _ in range(ORDER + 1)]
        for text in texts:
            data = PAD + text + PAD[:1]
            for p in range(ORDER, len(data)):
                for d in range(ORDER + 1):
                    self.seen[d][data[p - d : p]][data[p]] += 1

    def byte(self, context, byte):
        out, barred = 0.0, set()
        for d in range(ORDER, -1, -1):
            counts = {b: n for b, n in self.seen[d].get(context[ORDER - d :], {}).items() if b not in barred}
            if not counts:
                continue
            scale = sum(counts.values()) + len(counts)
            if byte in counts:
                return out + math.log10(counts[byte] / scale)
            out += math.log10(len(counts) / scale)
            barred |= set(counts)
        return out - math.log10(256 - len(barred))

    def score(self, text):
        data = PAD + text + PAD[:1]
        return sum(self.byte(data[p - ORDER : p], data[p]) for p in range(ORDER, len(data)))


def compare(rows, scored):
    low = [((t or "").encode().lower(), held(i)) for i, t in rows]
    words = Counter()
    for text, out in low:
        if not out:
            words.update(text.split())
            words[None] += 1
    total = sum(words.values())
    norm = math.log10(total + 0.1 * (len(words) + 1))
    model = Plain([t for t, out in low if not out])
    want = []
    for (i, _), (text, out) in zip(rows, low):
        tokens = [*text.split(), None]
        base = sum(math.log10(words[w] + 0.1) - norm for w in tokens)
        want.append((i, out, len(tokens), sum(words[w] > 0 for w in tokens), total, base, model.score(text)))
    got = [tuple(r) for r in scored.collect()]
    key = lambda r: repr(r[:5]) + f"{r[5]:.6f}"
    for x, y in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert x[:5] == y[:5]
        assert x[5:] == pytest.approx(y[5:], rel=1e-9)


def test_like_plain_model_on_awkward_rows(spark):
    rows = ROWS[:7] + ROWS[8:] + [(i, t) for i, t in zip(range(20, 60), ["abab", "the cat", "Ünï", "\x00\x7f", "zzz q"] * 8)]
    compare(rows, score_corpus(clashing(documents(spark, rows)), 10, 0))


def test_many_blocks_like_one(spark, monkeypatch):
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 200)
    monkeypatch.setattr(ppm, "WORD_ENTRIES", 5)
    rows = [(i, f"word{i % 7} the text of {i} and word{i % 3} again") for i in range(80)]
    compare(rows, score_corpus(documents(spark, rows), 10, 0))


def test_every_row_of_the_query_and_fluent_before_shuffled(spark):
    scored = LLM_QUERIES["op8_ppm"](spark, FOLDER).toPandas()
    assert len(scored) == 200 and (scored.score < 0).all() and scored.train_tokens.nunique() == 1


def test_probabilities_of_all_bytes_add_up_to_one(spark):
    docs = documents(spark, [(i, t) for i, t in enumerate(["abracadabra", "the theory", "ab", ""])])
    trie = Trie(*learn_grams(docs))
    for context in (b"\xff\xff\xff\xff\xff", b"abrac", b"xxxxa", b"qqqqq", b"e the"):
        grams = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert (10 ** trie.log10(grams)).sum() == pytest.approx(1.0)


def test_capacity_keeps_a_proper_model(spark):
    docs = documents(spark, [(i, "one two three two one " * 3 + str(i)) for i in range(9)])
    grams, counts = learn_grams(docs, capacity=20)
    assert len(grams) == 20
    trie = Trie(grams, counts)
    keys = np.array([int.from_bytes(b"one t" + bytes([b]), "big") for b in range(256)], np.uint64)
    assert (10 ** trie.log10(keys)).sum() == pytest.approx(1.0)


def test_no_gram_of_a_large_corpus_is_left_out(spark):
    # 4,000 texts of 1,000 random letters: 3.6 million different grams to learn from, nearly all of them seen once.
    letters = np.random.default_rng(4).integers(ord("a"), ord("z") + 1, (4000, 1000)).astype(np.uint8)
    texts = [row.tobytes() for row in letters]
    path = str(ppm.scratch_dir(spark, "random"))
    spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(path)
    parts = [ppm._grams([t])[0] for i, t in enumerate(texts) if not held(i)]
    whole = Trie(*np.unique(np.concatenate(parts), return_counts=True))
    assert whole.direct.filled.sum() > 3_000_000
    got = {r.doc_id: r.score for r in score_corpus(spark.read.parquet(path), 10, 0).select("doc_id", "score").collect()}
    for i in (*range(40), 3998, 3999):
        assert got[i] == pytest.approx(whole.log10(ppm._grams([texts[i]])[0]).sum(), rel=1e-9)


def test_hash_table_finds_all_and_nothing_else():
    random = np.random.default_rng(1)
    keys = np.unique(random.integers(0, 1 << 40, 5000).astype(np.uint64))
    table = HashTable.build(keys, np.arange(len(keys)))
    assert (table.values[table.find(keys)] == np.arange(len(keys))).all()
    assert (table.find(np.setdiff1d(np.arange(1000, dtype=np.uint64), keys)) == -1).all()


def test_no_training_rows_and_no_rows(spark):
    only_held = [(i, "a b") for i in range(400) if held(i)]
    rows = score_corpus(documents(spark, only_held), 10, 0).collect()
    assert len(rows) == len(only_held) and {r.n_known for r in rows} == {0} and {r.train_tokens for r in rows} == {0}
    assert score_corpus(documents(spark, []), 10, 0).collect() == []


def test_looking_up_a_long_text_takes_little_memory():
    """A task looks up blocks of 16 MB; what a lookup holds for each byte must not be there for megabytes at a time."""
    texts = [bytes([97 + i % 26]) * 1000 for i in range(4000)]
    grams = np.unique(ppm._grams(texts[:26])[0])
    table = HashTable.build(grams, np.zeros(len(grams)))
    tracemalloc.start()
    scores = ppm.text_scores(texts, table.values_of)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(scores) == 4000 and peak < 50e6
