import hashlib
import json

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from scholium.llm.bpe import Remembered, TokenAutomaton, WordBpe, add_tokens, decode_ids, encode_texts
from scholium.llm.queries import LLM_QUERIES
from scholium.llm.settings import VOCABULARY, vocabulary
from scholium.llm.texts import task_cache
from tests.llm.frames import FOLDER, ROWS, clashing, documents

BPE = WordBpe(json.loads(vocabulary()))
LIBRARY = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
LIBRARY.no_truncation()
LIBRARY.no_padding()


def check(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(BPE.encode(text), "<u4").tolist() == ids
    assert BPE.decode(BPE.encode(text)) == LIBRARY.decode(ids, skip_special_tokens=False)


@given(st.text(max_size=60))
@settings(max_examples=400, deadline=None)
def test_any_text_like_the_library(text):
    check(text)


@given(st.text(alphabet="abcehlnorst  '.,!?0ÀÉßΣİ́\x1c\x85\xa0　日🙂<|>", max_size=60))
@settings(max_examples=800, deadline=None)
def test_awkward_texts_like_the_library(text):
    check(text)


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "<|startoftext|><|endoftext|>", "<|STARTOFTEXT|>", "ciónllllas", "a" * 5000, "It's I'LL we've"])
def test_chosen_texts_like_the_library(text):
    check(text)


def merge_by_rank(word, ranks):
    parts = list(word)
    while True:
        pairs = [(ranks[a, b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in ranks]
        if not pairs:
            return parts
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("abc")), max_size=3), st.data())
@settings(max_examples=150, deadline=None)
def test_automaton_of_any_merge_list_like_merging_by_rank(first, data):
    vocabulary_ = {c: i for i, c in enumerate("abc")}
    merges = []
    for _ in range(8):
        tokens = sorted(vocabulary_)
        a, b = data.draw(st.sampled_from(tokens)), data.draw(st.sampled_from(tokens))
        if a + b not in vocabulary_ and len(a + b) < 8:
            vocabulary_[a + b] = len(vocabulary_)
            merges.append((a, b))
    automaton = TokenAutomaton(vocabulary_, merges)
    ranks = {pair: i for i, pair in enumerate(merges)}
    for _ in range(10):
        word = data.draw(st.text(alphabet="abc", min_size=1, max_size=12))
        assert [automaton.spelling[t] for t in automaton.path(word)] == merge_by_rank(word, ranks)


def test_query_on_whole_documents(spark):
    texts = dict(zip(*[pq.read_table(f"{FOLDER}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "text")]))
    rows = LLM_QUERIES["op2_bpe"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = LIBRARY.encode(texts[row.doc_id], add_special_tokens=False).ids
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_awkward_rows(spark):
    df = clashing(documents(spark))
    got = encode_texts(df, vocabulary()).collect()
    assert len(got) == len(ROWS)
    by_id = {row.doc_id: row for row in got}
    assert by_id[3].n_tokens == 0 and by_id[3].decoded == "" and by_id[4].n_tokens == 0
    whole = add_tokens(df, vocabulary())
    assert [c for c in whole.columns if c not in df.columns] == ["decoded_sha256"]
    again = decode_ids(whole, vocabulary(), into="again").collect()
    for row in again:
        assert row.again == LIBRARY.decode(LIBRARY.encode(row.text or "", add_special_tokens=False).ids, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(row.again.encode()).hexdigest()
    assert add_tokens(documents(spark, []), vocabulary()).collect() == []


def test_caches_stay_within_their_bytes(monkeypatch):
    kept = Remembered(1000)
    for i in range(100):
        kept.add(f"word {i}", b"1234")
        assert kept[f"word {i}"] == b"1234" and kept.held < 1300 and len(kept) < 7
    small = WordBpe(json.loads(vocabulary()))
    small.words, small.chunks = Remembered(500), Remembered(500)
    text = " ".join(f"some,words{i}" for i in range(50))
    assert np.frombuffer(small.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_an_operator_drops_what_others_left_in_the_worker():
    left = {"a": 1}
    task_cache("other operator", left.clear)
    task_cache("other operator", left.clear)
    assert left
    task_cache("this operator", dict().clear)
    assert not left
