import math

import zstandard
from pyspark.sql import functions as F

from scholium.llm import quality
from scholium.llm.labelled import fold_of, labelled_sample
from scholium.llm.quality import score_quality, train_quality
from scholium.llm.queries import LLM_QUERIES
from tests.llm.frames import ROWS, clashing, documents
from tests.llm.test_toxicity import auc

FOLDER = "/root/testdata/sf0.01"


def test_held_out_documents(spark):
    rows = LLM_QUERIES["op7_quality"](spark, FOLDER).toPandas()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas()
    assert len(rows) == 1000 and rows.score.between(0, 1).all()
    assert (rows.predicted == (rows.score >= 0.3)).all()
    held = rows[rows.held_out].merge(labels, on="doc_id")
    assert auc(held.quality, held.score) > 0.95
    assert (held.predicted == held.quality).mean() > 0.9


def test_awkward_rows(spark):
    df = clashing(documents(spark))
    labels = spark.createDataFrame([(1, None), (2, 0), (5, 1), (5, 0), (7, 1), (8, 0), (None, 1)], "doc_id long, quality int")
    for train in (labels, labels.limit(0), labels.where("quality = 1")):
        model = train_quality(df, train, fold_of("doc_id", 5) != 99)
        scored = score_quality(df, model).collect()
        assert len(scored) == len(ROWS) and all(0 <= r.score <= 1 for r in scored)
        assert len({r.score for r in scored if r.doc_id == 3}) == 1
    assert score_quality(documents(spark, []), model).collect() == []


def test_one_text_of_each_sampled_id(spark):
    docs = documents(spark, [(1, "b")] * 500 + [(1, "a"), (2, "c"), (3, "d"), (4, None)])
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "doc_id long, keep int")
    sample = labelled_sample(docs, labels, "keep", F.lit(True), 10)
    assert sample.texts == ["a", "c", "d", ""] and list(sample.labels) == [1, 1, 0, 0]
    assert list(sample.weights) == [1.0, 1.0, 1.0, 1.0]


def test_scores_are_those_of_compressed_sizes(spark):
    """Sizes, normalisation and curve once more, with nothing but the compressor."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(150)
    model = train_quality(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"), fold_of("doc_id", 5) != 0)
    assert 0 < len(model.good) <= 32_768 and 0 < len(model.bad) <= 32_768

    def size(piece, dictionary):
        data = zstandard.ZstdCompressionDict(dictionary)
        return len(zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False).compress(piece))

    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in score_quality(docs, model).collect():
        raw = texts[row.doc_id].encode()
        pieces = [raw[i : i + quality.PIECE_BYTES] for i in range(0, len(raw), quality.PIECE_BYTES)]
        gap = sum(size(p, model.bad) - size(p, model.good) for p in pieces) / len(raw)
        want = 1 / (1 + math.exp(-(model.beta[0] + model.beta[1] * 100 * gap)))
        assert abs(row.score - want) < 1e-9
    assert model.scores([""])[0] == 1 / (1 + math.exp(-model.beta[0]))


def test_few_and_tiny_texts_are_their_own_dictionary(spark):
    assert quality.build_dictionary(["some words that are too few"]) == b"some words that are too few"
    assert quality.build_dictionary(["x" * 100_000]).endswith(b"x") and quality.build_dictionary([]) == b""
    rows = [(i, f"good text {i} with words" if i % 2 else f"bad {i} !!! ???") for i in range(10)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    model = train_quality(documents(spark, rows), labels, F.lit(True))
    # Five of each label: all of them stand in the dictionaries.
    assert all(text.encode() in (model.good if i % 2 else model.bad) for i, text in rows)
