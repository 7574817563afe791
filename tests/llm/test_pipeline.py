import hashlib

import duckdb
import numpy as np

import corpus_pipeline
from scholium.llm import settings
from scholium.llm.labelled import fold_of
from scholium.llm.mixing import mixing_sql
from scholium.llm.queries import LLM_QUERIES
from scholium.llm.toxicity import score_toxicity, train_toxicity
from tests.llm.frames import clashing, documents
from tests.llm.test_bpe import LIBRARY
from tests.llm.test_exact_dedup import brute as same_texts
from tests.llm.test_jaccard import brute as similar_texts

FOLDER = "/root/testdata/sf0.001"


def test_like_plain_python(spark):
    """Every stage but the tagger against brute force on what the one before it kept."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = train_toxicity(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"), fold_of("doc_id", 3) != 1)
    toxic = {r.doc_id for r in score_toxicity(docs, model).where("score >= 0.7").collect()}
    assert 0 < len(toxic) < 60
    frame = docs.toPandas()
    frame = frame[~frame.doc_id.isin(toxic)]
    single = {r[0] for r in same_texts(list(zip(frame.doc_id, frame.text))) if r[3]}
    frame = frame[frame.doc_id.isin(single)]
    apart = {d for d, n, name in similar_texts(list(zip(frame.doc_id, frame.text))) if d == name}
    frame = frame[frame.doc_id.isin(apart)]
    mixed = duckdb.sql(mixing_sql("frame", settings.MIX, settings.MIX_OTHERS)).df()
    want = []
    for row in mixed.itertuples():
        ids = LIBRARY.encode(row.text, add_special_tokens=False).ids
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        want.append((row.doc_id, row.text, row.lang, row.source, row.n_chars, len(ids), ids, hashlib.sha256(decoded.encode()).hexdigest()))
    got = [tuple(r) for r in LLM_QUERIES["pipeline"](spark, FOLDER).collect()]
    assert sorted(got) == sorted(want)


def test_stages_keep_columns_and_take_awkward_rows(spark):
    df = clashing(documents(spark))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, FOLDER)
        assert out.count() > 0
        if name != "bpe":
            assert out.columns == df.columns, name
            assert {r.copy_no for r in out.collect()} == {"x"}, name
        assert stage(spark, documents(spark, []), FOLDER).collect() == [], name
    assert np.array_equal([n for n, _ in corpus_pipeline.STAGES], ["toxicity", "exact_dedup", "jaccard_join", "mixing", "bpe"])
