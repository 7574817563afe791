"""Notes and documents: listing, keyword filter, page cleaning, sentences, summaries, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.functions.text import contains_text, page_title, plain_text
from scholium.operators.rows import drop_blank
from scholium.operators.terms import sentence_rows, sentence_scores, sentences_at, word_places
from scholium.plans import lead_in_order, top_per_key


def list_notes(
    df: DataFrame, title: str, subject: str, description: str, created: str, only: str | None = None
) -> DataFrame:
    """Notes newest first, of one subject if asked for; ``description`` is a column of the notes and returned whole."""
    chosen = df if only is None else df.where(F.col(subject) == only)
    return chosen.select(
        F.col(title).alias("title"),
        F.col(subject).alias("subject"),
        F.col(description).alias("description"),
        F.col(created).alias("created"),
    ).orderBy(F.col("created").desc(), "title")


def keyword_filter(df: DataFrame, text: str, query: str) -> DataFrame:
    """Case-insensitive contains; a blank query keeps every row."""
    return df.where(contains_text(text, query))


def clean_pages(df: DataFrame, html: str) -> DataFrame:
    """Title and reading text of raw pages."""
    return df.withColumn("title", page_title(html)).withColumn("text", plain_text(html)).drop(html)


def extract_notes(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Sentences of each document in order."""
    return sentence_rows(df, doc_id, text)


def summarise(docs: DataFrame, doc_id: str, title: str, text: str, k: int) -> DataFrame:
    """The ``k`` sentences with the highest mean idf, joined in text order."""
    scored = sentence_scores(word_places(docs, doc_id, text), doc_id, k)
    best = top_per_key(scored, [doc_id], [F.col("score").desc(), F.col("pos")], k)
    chosen = best.groupBy(doc_id).agg(F.sort_array(F.collect_list("pos")).alias("_chosen"))
    # The sentences come from the document again, so no text travels with the words.
    picked = docs.select(doc_id, F.col(title).alias("title"), F.col(text).alias("_text")).join(chosen, doc_id)
    return sentences_at(picked, "_text", "_chosen").select(
        doc_id,
        "title",
        F.array_join("_text", " ").alias("summary"),
        F.size("_chosen").cast("bigint").alias("n_sentences"),
    )


def clean_transcript(messages: DataFrame, text: str = "text") -> DataFrame:
    """Messages trimmed, blank ones dropped."""
    return drop_blank(messages, text)


def pair_turns(
    messages: DataFrame, conversation: str, turn: str, role: str = "role", text: str = "text"
) -> DataFrame:
    """Each user message that an assistant message follows, with that reply."""
    followed = lead_in_order(messages, conversation, turn, [turn, role, text])
    return followed.where((F.col(role) == "user") & (F.col(f"next.{role}") == "assistant")).select(
        conversation,
        turn,
        F.col(text).alias("question"),
        F.col(f"next.{turn}").alias("reply_turn"),
        F.col(f"next.{text}").alias("reply"),
    )


def apply_note_changes(
    notes: DataFrame, changes: DataFrame, key: str, action: str = "action", order: str = "seq"
) -> DataFrame:
    """Create, replace and delete: the latest change of a note wins, untouched notes stay.

    ``changes`` has the columns of ``notes`` besides ``action`` (create, replace or delete) and
    an order column.
    """
    columns = notes.columns
    latest = changes.groupBy(key).agg(
        F.max_by(F.struct(action, *[c for c in columns if c != key]), order).alias("_last")
    )
    written = latest.where(F.col(f"_last.{action}") != "delete").select(
        *[F.col(key) if c == key else F.col(f"_last.{c}").alias(c) for c in columns]
    )
    untouched = notes.join(latest.select(key), key, "left_anti")
    return untouched.select(*columns).unionByName(written)
