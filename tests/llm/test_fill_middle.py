import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from scholium.llm.fill_middle import cut_pieces, fill_in_middle, rearranged, restore_texts, restored, split_texts, unit_lists
from scholium.llm.queries import LLM_ORACLES, LLM_QUERIES
from tests.llm.frames import FOLDER, LONG, ROWS, clashing, documents
from tests.oracle import differences

AWKWARD = st.text(alphabet="ab<PSM> Éß日🙂\x00\n", max_size=40)


def brute(doc_id, text):
    """The contract, said with slices of a Python string."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 10**12)), st.one_of(st.text(max_size=30), AWKWARD)), max_size=12), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_any_batch_like_slices_of_strings(rows, most):
    """Slices of a few bytes cut nearly every text into several pieces."""
    texts = pa.array([t for _, t in rows], pa.string())
    got = rearranged(texts, [None if i is None else str(i) for i, _ in rows], most=most)
    want = [brute(i, t) for i, t in rows]
    assert list(zip(*[got[c].to_pylist() for c in ("n", "form", "prefix_chars", "middle_chars", "output")])) == want
    assert restored(got["output"], got["form"]).to_pylist() == texts.to_pylist()


@given(st.lists(st.text(max_size=20), max_size=8), st.integers(0, 4), st.integers(1, 7))
@settings(max_examples=200, deadline=None)
def test_units_and_pieces_of_part_of_an_array(texts, skip, most):
    array = pa.array(texts, pa.string()).slice(skip)
    texts = texts[skip:]
    assert unit_lists(array).to_pylist() == [list(t) for t in texts]
    pieces, first = cut_pieces(array, most)
    assert ["".join(pieces.to_pylist()[a:b]) for a, b in zip(first, first[1:])] == texts
    assert all(len(p.encode()) <= most + 3 for p in pieces.to_pylist())


def test_a_text_of_many_slices():
    text = "añ日🙂" * 100_000
    parts = split_texts(pa.array([text]), np.array([7]), np.array([350_001]), most=10_000)
    assert [p[0].as_py() for p in parts] == [text[:7], text[7:350_001], text[350_001:]]


def test_query_like_sql(spark):
    problems, rows, _ = differences(spark, FOLDER, "op12_fill_middle", LLM_QUERIES, LLM_ORACLES)
    assert not problems
    assert rows == 200


def test_awkward_rows(spark):
    rows = ROWS + [(20, "a <M> b"), (21, "<P"), (22, "🙂" * 50_000), (23, " ".join(map(str, range(50_000))))]
    got = restore_texts(fill_in_middle(clashing(documents(spark, rows)))).collect()
    assert sorted((r.doc_id, r.restored, *r[1:6]) for r in got if r.doc_id is not None) == sorted(
        (i, t or "", *brute(i, t)) for i, t in rows if i is not None
    )
    assert sorted(r.restored for r in got if r.doc_id is None) == ["", "Alpha beta"]
    assert {r.form for r in got if r.doc_id == 20} == {"plain"} and any(r.restored == LONG for r in got)
    assert restore_texts(fill_in_middle(documents(spark, []))).collect() == []


def test_restoring_keeps_columns_and_takes_nulls(spark):
    df = spark.createDataFrame([("x", None, None), ("y", "<P>a<S>c<M>b", "psm"), ("z", "a", None)], "restored string, output string, form string")
    assert restore_texts(df).columns == ["output", "form", "restored"]
    assert sorted(r.restored for r in restore_texts(df).collect()) == ["", "a", "abc"]
    with pytest.raises(Exception):
        restore_texts(spark.createDataFrame([("abc", "psm")], "output string, form string")).collect()
