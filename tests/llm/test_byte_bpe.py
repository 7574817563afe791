import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from scholium.llm import byte_bpe
from scholium.llm.byte_bpe import ByteBpe, RankQueue, decode_bytes, encode_bytes
from scholium.llm.queries import LLM_QUERIES
from scholium.llm.settings import BYTE_PATTERN, byte_ranks
from tests.llm.frames import FOLDER, ROWS, clashing, documents

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, byte_ranks().splitlines())}
BPE = ByteBpe(RANKS, BYTE_PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def check(text):
    ids = LIBRARY.encode_ordinary(text)
    coded = BPE.encode([text])[0]
    assert np.frombuffer(coded, "<u4").tolist() == ids
    assert BPE.decode(coded) == LIBRARY.decode_bytes(ids) == text.encode()


@given(st.text(max_size=60))
@settings(max_examples=400, deadline=None)
def test_any_text_like_the_library(text):
    check(text)


@given(st.text(alphabet="abcehlnorst''  \n\t.,!?012ÀÉß日本語🙂<|>\x1c\x85\xa0", max_size=80))
@settings(max_examples=600, deadline=None)
def test_awkward_texts_like_the_library(text):
    check(text)


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, " " * 3000 + "x", "=" * 4097, "日本" * 2000, "It's we'll I'M", "<|endoftext|>", "ab" * 3000 + "c"])
def test_chosen_texts_like_the_library(text):
    check(text)


def test_texts_longer_than_a_window(monkeypatch):
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 10)
    monkeypatch.setattr(byte_bpe, "DECODE_IDS", 3)
    check("some words  and\n\nlines of text, 日本語 " * 20)


def test_a_full_cache_starts_again(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 2000)
    small = ByteBpe(RANKS, BYTE_PATTERN)
    for turn in range(4):
        texts = [" ".join(f"word{i}" for i in range(turn * 100, turn * 100 + 120)), "x" * 500, ""]
        assert [np.frombuffer(ids, "<u4").tolist() for ids in small.encode(texts)] == LIBRARY.encode_ordinary_batch(texts)
        assert len(small.known) < 130 and not any(len(word) > 128 for word in small.known)
    assert small.held == sum(len(w) + len(ids) + byte_bpe.ENTRY_BYTES for w, ids in small.known.items())


def test_batches_like_one_text_at_a_time(monkeypatch):
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 30)
    texts = ["", "a", "some more than thirty characters, that is", "a", "日本" * 40, "end"]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in BPE.encode(texts)] == LIBRARY.encode_ordinary_batch(texts)


def merge_by_rank(word, ranks):
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@given(st.lists(st.binary(min_size=2, max_size=6), max_size=40, unique=True), st.randoms(use_true_random=False), st.lists(st.binary(max_size=40), max_size=5))
@settings(max_examples=150, deadline=None)
def test_any_ranks_like_merging_one_by_one(tokens, shuffled, words):
    """Ranks in any order: a merge may bring up a pair of lower rank, or leave stale entries behind."""
    tokens = [bytes(b % 3 for b in t) for t in tokens]
    tokens = [*dict.fromkeys([*(bytes([i]) for i in range(256)), *tokens])]
    order = list(range(len(tokens)))
    shuffled.shuffle(order)
    ranks = dict(zip(tokens, order))
    own = ByteBpe(ranks, r"(?s).+")
    words = [w for w in [bytes(b % 3 for b in w) for w in words] if w] + [bytes([0, 1, 0, 0, 1, 2] * 5)]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in own.merged(words)]
    assert got == [merge_by_rank(word, ranks) for word in words]
    assert own.queue.take() is None and not any(own.queue.words) and not any(own.queue.buckets)


@pytest.mark.parametrize("ranks", [1, 256, 257, 65_536, 300_000])
def test_queue_in_order_of_rank_and_place(ranks):
    draw, queue, held = random.Random(ranks), RankQueue(ranks), {}
    for step in range(2000):
        if draw.random() < 0.6:
            rank, place = draw.randrange(ranks), draw.randrange(10**6)
            held.setdefault(rank, []).append(place)
            queue.push(rank, place)
        else:
            lowest = min(held) if held else None
            assert queue.take() == (None if lowest is None else (lowest, sorted(held.pop(lowest))))
    assert [queue.take() for _ in range(len(held) + 1)] == [*((r, sorted(held[r])) for r in sorted(held)), None]


def test_one_word_of_a_megabyte_costs_little_more_than_its_length():
    draw = random.Random(5)
    spent = []
    for size in (20_000, 200_000):
        word = bytes(draw.choice(b"abcdefgh") for _ in range(size))
        start = time.process_time()
        ids = BPE.merged([word])[0]
        spent.append(time.process_time() - start)
        assert BPE.decode(ids) == word
    assert spent[1] < 40 * spent[0]


def test_a_byte_without_rank_is_refused():
    with pytest.raises(ValueError):
        ByteBpe({bytes([i]): i for i in range(255)}, BYTE_PATTERN)


def test_query_on_whole_documents(spark):
    texts = dict(zip(*[pq.read_table(f"{FOLDER}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "text")]))
    rows = LLM_QUERIES["op13_byte_bpe"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = LIBRARY.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_awkward_rows(spark):
    rows = ROWS + [(20, "x" * 300_000), (21, " ".join(map(str, range(30_000))))] + [(22, "again")] * 300
    coded = encode_bytes(clashing(documents(spark, rows)), byte_ranks(), BYTE_PATTERN)
    got = decode_bytes(coded, byte_ranks(), BYTE_PATTERN, into="again").collect()
    want = sorted(((i, (t or "").encode()) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in got), key=repr) == want
    assert sorted(((r.doc_id, bytes(r.again)) for r in got), key=repr) == want
    assert all(r.n_tokens == len(r.ids) // 4 for r in got) and {r.n_tokens for r in got if r.doc_id == 3} == {0}
    assert encode_bytes(documents(spark, []), byte_ranks(), BYTE_PATTERN).collect() == []
