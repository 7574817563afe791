"""Flashcards and cloze quizzes taken from the documents themselves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.functions.columns import case_label
from scholium.functions.text import blank_out
from scholium.operators.terms import (
    ANSWER_LENGTH,
    Vocabulary,
    contending_words,
    document_frequency,
    rounded,
    sentences_at,
    word_places,
)
from scholium.plans import number_rows, top_per_key, weighted_lookup, written

LEVELS = ("Easy", "Medium", "Hard")
DISTRACTORS = 3
# Ranks that meet in one key of the join of answers and their neighbours.
RANK_BAND = 256


def key_terms(places: DataFrame, counted: DataFrame, doc_id: str, k: int) -> DataFrame:
    """The ``k`` words of each document with the highest tf-idf, long ones first, and their first sentence's position.

    ``places`` is what ``word_places`` gives, ``counted`` the number of these documents (``df``) that use a ``term``, as a written table.
    Shorter words are taken where a document has no others.
    """
    vocabulary = Vocabulary.of(counted, places.count())
    filled = vocabulary.fill(contending_words(places, vocabulary, doc_id, k), doc_id)
    scored = filled.select(doc_id, "term", "pos", rounded(F.col("tf") * F.col("idf")).alias("score"))
    is_short = F.length("term") < ANSWER_LENGTH
    return top_per_key(scored, [doc_id], [is_short, F.col("score").desc(), F.col("term")], k)


def make_flashcards(docs: DataFrame, doc_id: str, title: str, text: str, k: int, keep: Sequence[str] = ()) -> DataFrame:
    """Cards (title, question, answer): the sentence of a key word with the word blanked."""
    places = word_places(docs, doc_id, text)
    return _cards(docs, key_terms(places, written(document_frequency(places), "frequency"), doc_id, k), doc_id, title, text, keep)


def _cards(docs: DataFrame, chosen: DataFrame, doc_id: str, title: str, text: str, keep: Sequence[str]) -> DataFrame:
    card = F.struct("pos", F.col("position").alias("card"), F.col("term").alias("answer"))
    cards = chosen.groupBy(doc_id).agg(F.collect_list(card).alias("_cards"))
    # Each document meets its few cards once and is split into sentences once.
    met = docs.select(doc_id, F.col(title).alias("title"), *keep, F.col(text).alias("_text")).join(cards, doc_id)
    told = sentences_at(met.withColumn("_at", F.col("_cards.pos")), "_text", "_at")
    return told.select(doc_id, "title", *keep, F.inline(F.arrays_zip("_cards", F.col("_text").alias("sentence")))).select(
        doc_id, "title", F.col("_cards.card").alias("card"), blank_out("sentence", "_cards.answer").alias("question"),
        F.col("_cards.answer").alias("answer"), *keep,
    )


def ranked_vocabulary(counted: DataFrame, lang: str) -> DataFrame:
    """Words of each language by falling document frequency, with rank, size and difficulty third."""
    ranked = number_rows(counted, [F.col("df").desc(), F.col("term")], [lang], "rank", "size")
    # Thirds as even as possible, the first ones taking the remainder.
    base, rest = F.floor(F.col("size") / 3), F.col("size") % 3
    first, second = base + (rest > 0).cast("bigint"), base + (rest > 1).cast("bigint")
    level = case_label(
        [(F.col("rank") <= first, LEVELS[0]), (F.col("rank") <= first + second, LEVELS[1])], LEVELS[2]
    )
    return ranked.select(lang, "term", "df", "rank", "size", level.alias("difficulty"))


def rank_neighbours(vocabulary: DataFrame, asked: DataFrame, lang: str, ahead: int, band: int = RANK_BAND) -> DataFrame:
    """For each word in ``asked`` (with its ``rank`` and its language's ``size``) the words of the ``ahead`` ranks behind it.

    Round the end of the ranking, and never the word itself. A range join in bands of ranks: a word asks in the one or two bands its range
    touches (and in the first where it goes round), every row of the vocabulary stands in its own band alone. Each
    key thus has at most ``band`` words on either side. Gives language, ``answer`` and ``term``.
    """
    last = F.col("rank") + F.least(F.lit(ahead), F.col("size") - 1)
    span = lambda low, high: F.struct(low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))
    spans = F.array(span(F.col("rank") + 1, F.least(last, F.col("size"))), span(F.lit(1), last - F.col("size")))
    ranges = asked.select(lang, F.col("term").alias("answer"), F.inline(F.filter(spans, lambda s: s["low"] <= s["high"])))
    of = lambda rank: F.floor((rank - 1) / band)
    probes = ranges.withColumn("_band", F.explode(F.sequence(of(F.col("low")), of(F.col("high")))))
    standing = vocabulary.select(lang, "term", "rank", of(F.col("rank")).alias("_band"))
    met = standing.join(probes, [lang, "_band"]).where(F.col("rank").between(F.col("low"), F.col("high")))
    return met.select(lang, "answer", "term")


def make_quiz(
    docs: DataFrame,
    doc_id: str,
    title: str,
    text: str,
    lang: str,
    topic: str | None = None,
    difficulty: str | None = None,
    n: int | None = None,
) -> DataFrame:
    """One cloze question per document that has a word, with four options, one of them right.

    The wrong options are the answer's neighbours in the language's frequency ranking, so they
    are about as common; a language of fewer than four words has as many options as words. ``topic`` keeps documents
    of one title, ``difficulty`` a third of the vocabulary, ``n`` the first questions by document.
    """
    on_topic = F.lit(True) if topic is None else F.col(title) == topic
    places = word_places(docs, doc_id, text, title, lang)
    # Words by language, over all documents and over the chosen ones: one count serves both.
    counted = written(document_frequency(places, lang, when=on_topic), "frequency")
    of_chosen = written(counted.where("df_when > 0").groupBy("term").agg(F.sum("df_when").alias("df")), "chosen")
    chosen = key_terms(places.where(on_topic), of_chosen, doc_id, 1)
    cards = written(_cards(docs.where(on_topic), chosen, doc_id, title, text, [lang]), "cards")

    vocabulary = written(ranked_vocabulary(counted.drop("df_when"), lang), "vocabulary")
    answers = cards.select(lang, F.col("answer").alias("term")).distinct()
    asked = vocabulary.join(answers, [lang, "term"])
    others = rank_neighbours(vocabulary, asked, lang, DISTRACTORS).groupBy(lang, "answer").agg(F.collect_list("term").alias("_others"))
    offered = asked.withColumnRenamed("term", "answer").join(others, [lang, "answer"], "left")
    options = F.sort_array(F.array_append(F.coalesce("_others", F.array().cast("array<string>")), F.col("answer")))
    choices = offered.select(lang, "answer", "df", F.struct("difficulty", options.alias("options")).alias("choice"))
    # A word is the answer of no more documents than use it.
    uses = vocabulary.agg(F.sum("df")).scalar()
    quiz = weighted_lookup(cards, choices, [lang, "answer"], "df", "choice", [doc_id], uses)
    quiz = quiz.where(F.col("choice").isNotNull())
    if difficulty is not None:
        quiz = quiz.where(F.col("choice.difficulty") == difficulty)
    quiz = quiz.select(
        doc_id,
        F.col("title").alias("topic"),
        "choice.difficulty",
        "question",
        F.array_join("choice.options", " | ").alias("options"),
        F.array_position("choice.options", F.col("answer")).cast("bigint").alias("right_option"),
    )
    return quiz if n is None else quiz.orderBy(doc_id).limit(n)
