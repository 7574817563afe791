"""From documents to mixed and tokenized training data.

Each stage takes what the one before it kept, as a written table, and returns a DataFrame. All but the last
return the columns of documents; the last adds token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scholium.llm import settings
from scholium.llm.bpe import add_tokens
from scholium.llm.exact_dedup import drop_copies
from scholium.llm.jaccard_join import drop_similar
from scholium.llm.labelled import fold_of
from scholium.llm.mixing import mix_sources
from scholium.llm.texts import fresh
from scholium.llm.toxicity import drop_toxic, train_toxicity
from scholium.plans import scratch_dir
from scholium.sources import Tables

# The tagger and the shingles cannot be said in SQL; tests compare run() with plain Python.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger scores below the threshold."""
    train = fold_of("doc_id", settings.TOXIC_FOLDS) != settings.TOXIC_HELD_OUT
    model = train_toxicity(docs, Tables(spark, sf_dir)("labels"), train)
    return drop_toxic(docs, model, settings.TOXIC_THRESHOLD)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return drop_copies(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_similar(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources have their target weights, in shuffled order."""
    copy, key = fresh("copy_no", docs.columns), fresh("shuffle_key", docs.columns)
    mixed = mix_sources(docs, settings.MIX, settings.MIX_OTHERS, copy_column=copy, key_column=key)
    return mixed.select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and the digest of what these decode to."""
    return add_tokens(docs, settings.vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("mixing", mixing),
    ("bpe", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written below the shared checkpoint folder and reread."""
    docs = Tables(spark, sf_dir)("documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
