"""Content and search operators against brute force on small texts."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholium.operators import notes, pivots, practice, search
from scholium.operators.terms import word_places

DOCS = [
    (1, "en", "maths", "Graphs have vertices. Graphs have edges.\nTrees are graphs without cycles."),
    (2, "en", "maths", "Vectors span spaces. Matrices map vectors."),
    (3, "en", "bio", "Cells have walls. Cells divide. Trees grow."),
    (4, "en", "bio", "Trees trees trees. Walls."),
    (5, "en", "bio", ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, lang string, topic string, text string")


def bm25(docs, queries, k):
    words = {d: re.findall(r"[a-z]+", t.lower()) for d, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    best = {}
    for q, text in queries:
        scores = {}
        for term in set(re.findall(r"[a-z]+", text.lower())):
            df = sum(term in w for w in words.values())
            idf = math.log(1 + (len(words) - df + 0.5) / (df + 0.5))
            for d, w in words.items():
                if tf := w.count(term):
                    scores[d] = scores.get(d, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        ranked = sorted(scores.items(), key=lambda s: (-round(s[1], 6), s[0]))[:k]
        best.update({(q, p): (d, round(s, 6)) for p, (d, s) in enumerate(ranked, 1)})
    return best


@pytest.mark.parametrize("entries", [1000, 0])
def test_ranked_search(spark, docs, entries):
    queries = [("a", "graphs and TREES"), ("b", "walls walls"), ("c", "nothing here"), ("d", "")]
    frame = spark.createDataFrame(queries, "q string, text string")
    got = search.ranked_search(docs, frame, "doc_id", "text", "q", "text", 2, broadcast_entries=entries).collect()
    assert {(r.q, r.position): (r.doc_id, r.score) for r in got} == bm25([(d[0], d[3]) for d in DOCS], queries, 2)


def test_ranked_search_over_many_texts(spark):
    chance = random.Random(2)
    vocabulary = ["".join(chance.choices("abcdef", k=4)) for _ in range(60)]
    texts = [(i, " ".join(chance.choices(vocabulary, k=30))) for i in range(300)]
    texts += [(1000 + i, texts[0][1]) for i in range(150)]  # a third are copies of one text
    queries = [(f"q{i}", " ".join(chance.choices(vocabulary, k=5))) for i in range(20)]
    frame = spark.createDataFrame(texts, "d bigint, text string").repartition(5)
    asked = spark.createDataFrame(queries, "q string, text string")
    expected = bm25(texts, queries, 7)
    for entries in (10_000, 0):
        got = search.ranked_search(frame, asked, "d", "text", "q", "text", 7, broadcast_entries=entries).collect()
        assert {(r.q, r.position): (r.d, r.score) for r in got} == expected


@pytest.mark.parametrize("most", [100, 0])
def test_semantic_search(spark, most, monkeypatch):
    monkeypatch.setattr(pivots, "SLAB_QUERIES", 4)
    monkeypatch.setattr(pivots, "MATRIX_CELLS", 800)
    rng = np.random.default_rng(1)
    chunks = rng.normal(size=(500, 8)).astype(np.float32)
    chunks[100:300] = chunks[7]  # many copies of one vector
    chunks[400] = 0  # no direction
    queries = rng.normal(size=(11, 8)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(chunks)], "vec_id bigint, embedding array<float>")
    odd = spark.createDataFrame([(900, [1.0, 2.0]), (901, None), (902, [None] * 8)], frame.schema)
    asked = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(queries)], "query_id string, embedding array<float>")
    got = search.semantic_search(frame.union(odd).repartition(5), asked, 10, broadcast_queries=most).collect()
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    scores = np.round(unit(queries.astype(float)) @ unit(chunks.astype(float)).T, 6)
    expected = {}
    for i, row in enumerate(scores):
        order = sorted((j for j in range(500) if j != 400), key=lambda j: (-row[j], j))[:10]
        expected.update({(f"q{i}", p): (j, row[j]) for p, j in enumerate(order, 1)})
    assert {(r.query_id, r.position): r.vec_id for r in got} == {key: j for key, (j, _) in expected.items()}
    assert all(abs(r.score - expected[r.query_id, r.position][1]) < 2e-6 for r in got)


def test_no_queries_no_hits(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    asked = spark.createDataFrame([], "query_id string, embedding array<float>")
    assert search.semantic_search(chunks, asked, 3).count() == 0


def test_context_stays_within_budget(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    texts = spark.createDataFrame([(1, "aaaa"), (2, "bbbb"), (3, "c")], "doc_id bigint, text string")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    got = search.retrieve_context(chunks, texts, asked, 3, 10).first()
    assert (got.n_chunks, got.chars, got.context) == (2, 10, "aaaa\n\nbbbb")
    assert search.retrieve_context(chunks, texts, asked, 3, 9).first().n_chunks == 1
    assert tuple(search.retrieve_context(chunks, texts, asked, 3, 3).first()) == ("q", 0, 0, "")


@pytest.mark.parametrize("most", [100, 0])
def test_queries_of_any_width_are_answered(spark, most):
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0, 0.0])], "vec_id bigint, embedding array<float>")
    rows = [("narrow", [1.0, 0.0]), ("wide", [0.0, 1.0, 0.0])]
    for order in (rows, rows[::-1]):
        asked = spark.createDataFrame(order, "query_id string, embedding array<float>")
        got = search.semantic_search(chunks, asked, 3, broadcast_queries=most).collect()
        assert sorted((r.query_id, r.vec_id) for r in got) == [("narrow", 1), ("wide", 2)]


@pytest.mark.parametrize("kind, name", [("int", int), ("bigint", int), ("string", lambda i: f"d{i:03}")])
def test_both_ways_to_rank_give_the_same_rows_and_types(spark, kind, name):
    texts = [(name(i), f"alpha {'beta ' * (i % 5)} gamma{i % 7}") for i in range(60)]
    docs = spark.createDataFrame(texts, f"d {kind}, text string").repartition(4)
    asked = spark.createDataFrame([("q1", "beta gamma3"), ("q2", "alpha"), ("q3", "nothing"), ("q4", "")], "q string, text string")
    few, many = (search.ranked_search(docs, asked, "d", "text", "q", "text", 5, broadcast_entries=n) for n in (100, 0))
    assert few.dtypes == many.dtypes and dict(few.dtypes)["d"] == kind
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    assert few.count() == 10


def test_documents_of_short_words_have_a_card_and_a_question(spark):
    frame = spark.createDataFrame([(1, "t", "a big cat sat. it ran", "en"), (2, "t", "un", "fr")], "doc_id int, topic string, text string, lang string")
    assert practice.make_flashcards(frame, "doc_id", "topic", "text", 1).count() == 2
    quiz = {r.doc_id: r for r in practice.make_quiz(frame, "doc_id", "topic", "text", "lang").collect()}
    assert len(quiz[1].options.split(" | ")) == 4 and quiz[2].options == "un" and quiz[2].right_option == 1


def test_summary_keeps_text_order(docs):
    got = {r.doc_id: r for r in notes.summarise(docs, "doc_id", "topic", "text", 1).collect()}
    assert got[3].summary == "Cells divide"
    assert 5 not in got
    both = notes.summarise(docs, "doc_id", "topic", "text", 2).where("doc_id = 2").first()
    assert both.summary == "Vectors span spaces Matrices map vectors."


def test_flashcards(docs):
    got = [tuple(r) for r in practice.make_flashcards(docs, "doc_id", "topic", "text", 1).where("doc_id < 3").orderBy("doc_id").collect()]
    assert got == [
        (1, "maths", 1, "____ have vertices", "graphs"),
        (2, "maths", 1, "____ span spaces", "vectors"),
    ]


def test_quiz_has_four_options_and_one_right(docs):
    for row in practice.make_quiz(docs, "doc_id", "topic", "text", "lang").collect():
        options = row.options.split(" | ")
        assert len(set(options)) == 4
        assert "____" in row.question and options[row.right_option - 1] not in row.question.lower().split()
        assert row.difficulty in practice.LEVELS


def test_quiz_filters(docs):
    whole = practice.make_quiz(docs, "doc_id", "topic", "text", "lang").collect()
    by_topic = practice.make_quiz(docs, "doc_id", "topic", "text", "lang", topic="maths").collect()
    assert {r.doc_id for r in by_topic} == {1, 2}
    level = whole[0].difficulty
    of_level = practice.make_quiz(docs, "doc_id", "topic", "text", "lang", difficulty=level).collect()
    assert {r.doc_id for r in of_level} == {r.doc_id for r in whole if r.difficulty == level}
    assert practice.make_quiz(docs, "doc_id", "topic", "text", "lang", n=1).count() == 1


def test_turn_pairs(spark):
    talk = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 5, "user", "c"), (1, 6, "user", "d"), (1, 9, "assistant", "e"), (2, 0, "user", "f")]
    frame = spark.createDataFrame(talk, "c int, turn bigint, role string, text string")
    got = sorted((r.question, r.reply) for r in notes.pair_turns(frame, "c", "turn").collect())
    assert got == [("a", "b"), ("d", "e")]


def test_note_changes(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, text string")
    changes = [(1, "old", "replace", 1), (1, "new", "replace", 2), (2, None, "delete", 1), (4, "d", "create", 1), (5, "x", "create", 1), (5, None, "delete", 2)]
    frame = spark.createDataFrame(changes, "id int, text string, action string, seq int")
    assert sorted(tuple(r) for r in notes.apply_note_changes(base, frame, "id").collect()) == [(1, "new"), (3, "c"), (4, "d")]


def test_note_list(spark):
    base = spark.createDataFrame([("T1", "S", "x" * 100, 1), ("T2", "R", "y", 2)], "t string, s string, x string, at int")
    got = notes.list_notes(base, "t", "s", "x", "at").collect()
    assert [r.title for r in got] == ["T2", "T1"] and got[1].description == "x" * 100
    assert notes.list_notes(base, "t", "s", "x", "at", only="R").count() == 1
    assert notes.keyword_filter(base, "x", "").count() == 2


def test_words_and_their_places_are_found_inside_the_row(spark):
    texts = [(1, "B a b. A b!\nc"), (2, ""), (3, None), (4, "One one. ONE\n\none"), (5, "...")]
    frame = spark.createDataFrame(texts, "d int, text string")
    got = {r.d: r._terms for r in word_places(frame, "d", "text").collect()}
    found = {d: terms and [(t.term, t.places) for t in terms] for d, terms in got.items()}
    assert found[1] == [("a", [0, 1]), ("b", [0, 0, 1]), ("c", [2])]
    assert found[4] == [("one", [0, 0, 1, 2])]
    assert not found[2] and not found[3] and not found[5]


@pytest.mark.parametrize("band", [1, 3, 4, 256])
def test_rank_neighbours_like_counting_on(spark, band):
    """Languages of one word up to many; the last ranks go round."""
    sizes = {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5, "f": 23}
    rows = [(lang, f"{lang}{rank}", rank, size) for lang, size in sizes.items() for rank in range(1, size + 1)]
    vocabulary = spark.createDataFrame(rows, "lang string, term string, rank bigint, size bigint")
    asked = vocabulary.where("rank % 2 = 1 OR rank = size")
    got = sorted(map(tuple, practice.rank_neighbours(vocabulary, asked, "lang", 3, band).collect()))
    want = []
    for lang, term, rank, size in rows:
        if rank % 2 == 1 or rank == size:
            want += [(lang, term, f"{lang}{(rank - 1 + step) % size + 1}") for step in range(1, min(3, size - 1) + 1)]
    assert got == sorted(want)


def scans(df):
    """How often a plan splits texts into sentences or words."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(")


def test_texts_are_split_once_for_all_statistics(spark, docs):
    """What is left in the plan is the splitting into sentences that gives the text of cards and summaries."""
    for made in (
        notes.summarise(docs, "doc_id", "topic", "text", 2),
        practice.make_flashcards(docs, "doc_id", "topic", "text", 2),
        practice.make_quiz(docs, "doc_id", "topic", "text", "lang"),
    ):
        assert scans(made) == 0


def test_the_vocabulary_is_not_multiplied(spark, docs):
    vocabulary = spark.createDataFrame([("en", "x", 1, 1)], "lang string, term string, rank bigint, size bigint")
    plan = practice.rank_neighbours(vocabulary.repartition(2), vocabulary, "lang", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") <= 2
