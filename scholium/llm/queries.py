"""The training-data operators bound to the test tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm import settings
from scholium.llm.bpe import encode_texts
from scholium.llm.byte_bpe import encode_bytes
from scholium.llm.exact_dedup import exact_dedup
from scholium.llm.fill_middle import fill_in_middle, fill_in_middle_sql, restore_texts
from scholium.llm.hamming import nearest_codes, nearest_codes_sql
from scholium.llm.html_blocks import extract_text, train_html
from scholium.llm.jaccard_join import similar_documents
from scholium.llm.merkle import lowercased, merkle_manifest, merkle_sql
from scholium.llm.mixing import mix_sources, mixing_sql
from scholium.llm.pii import digest_spans, find_pii
from scholium.llm.ppm import score_corpus
from scholium.llm.quality import quality_of
from scholium.llm.toxicity import toxicity_of
from scholium.sources import Tables

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}

LLM_QUERIES["pipeline"] = corpus_pipeline.run


def bound(sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        LLM_QUERIES[build.__name__] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            LLM_ORACLES[build.__name__] = sql.strip()
        return build

    return register


@bound(
    """
    WITH texts AS (
        SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
        FROM documents
    ), groups AS (
        SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY norm
    )
    SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
    FROM texts t JOIN groups g ON t.norm = g.norm
    """
)
def op1_exact_dedup(t: Tables) -> DataFrame:
    return exact_dedup(t("documents"))


@bound()
def op2_bpe(t: Tables) -> DataFrame:
    return encode_texts(t("documents"), settings.vocabulary(), outputs=("ids_sha256", "decoded_sha256"))


@bound(mixing_sql("documents", settings.MIX, settings.MIX_OTHERS))
def op5_mixing(t: Tables) -> DataFrame:
    return mix_sources(t("documents"), settings.MIX, settings.MIX_OTHERS)


@bound()
def op7_quality(t: Tables) -> DataFrame:
    return quality_of(t("documents"), t("labels"), settings.QUALITY_FOLDS, settings.QUALITY_HELD_OUT, settings.QUALITY_THRESHOLD)


@bound()
def op6_toxicity(t: Tables) -> DataFrame:
    return toxicity_of(t("documents"), t("labels"), settings.TOXIC_FOLDS, settings.TOXIC_HELD_OUT, settings.TOXIC_THRESHOLD)


@bound()
def op3_pii(t: Tables) -> DataFrame:
    return digest_spans(find_pii(t("documents")))


@bound(nearest_codes_sql("embeddings", "{} % 100 = 0"))
def op4_hamming_topk(t: Tables) -> DataFrame:
    return nearest_codes(t("embeddings"), F.col("vec_id") % 100 == 0)


@bound()
def op9_html_text(t: Tables) -> DataFrame:
    pages = t("pages")
    return extract_text(pages, train_html(pages))


@bound()
def op8_ppm(t: Tables) -> DataFrame:
    return score_corpus(t("documents"), settings.PPM_FOLDS, settings.PPM_HELD_OUT)


@bound()
def op10_jaccard(t: Tables) -> DataFrame:
    return similar_documents(t("documents"))


@bound(fill_in_middle_sql("documents"))
def op12_fill_middle(t: Tables) -> DataFrame:
    whole = restore_texts(fill_in_middle(t("documents")))
    digests = [F.sha2(name, 256).alias(f"{name}_sha256") for name in ("output", "restored")]
    return whole.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


@bound()
def op13_byte_bpe(t: Tables) -> DataFrame:
    coded = encode_bytes(t("documents"), settings.byte_ranks(), settings.BYTE_PATTERN)
    return coded.select("doc_id", "n_tokens", *[F.sha2(name, 256).alias(f"{name}_sha256") for name in ("ids", "decoded")])


@bound(merkle_sql("documents", settings.TAMPERED_EVERY))
def op11_merkle(t: Tables) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % settings.TAMPERED_EVERY == 0
    changes = {"text": lowercased("text")}
    return merkle_manifest(t("documents"), changes, tampered, outputs=("proof_sha256", "folded_root"))
