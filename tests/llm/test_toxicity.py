import itertools
import math
import re

import numpy as np
import pandas as pd

from scholium.llm.labelled import Sample, fold_of
from scholium.llm.queries import LLM_QUERIES
from scholium.llm.toxicity import (
    TEXT_WINDOWS, WINDOW, ToxicModel, _pair_gap, _passes, _sigmoid, _windows, chain_log_odds, drop_toxic, label_tokens, score_toxicity,
    train_chain, train_toxicity,
)
from tests.llm.frames import ROWS, clashing, documents

FOLDER = "/root/testdata/sf0.01"


def auc(labels, scores):
    ranks = pd.Series(scores).rank().to_numpy()
    positive = np.asarray(labels) == 1
    n, m = positive.sum(), (~positive).sum()
    return (ranks[positive].sum() - n * (n + 1) / 2) / (n * m)


def test_marginals_like_enumeration():
    random = np.random.default_rng(0)
    steps = random.normal(size=(2, 2))
    sequences = [random.normal(size=n) for n in (1, 2, 5, 7, 0, 3)]
    for emissions, odds in zip(sequences, chain_log_odds(sequences, steps)):
        total = np.zeros((len(emissions), 2))
        for tags in itertools.product((0, 1), repeat=len(emissions)):
            weight = math.exp(sum(e for e, y in zip(emissions, tags) if y) + sum(steps[a, b] for a, b in zip(tags, tags[1:])))
            for t, y in enumerate(tags):
                total[t, y] += weight
        assert np.allclose(odds, np.log(total[:, 1] / total[:, 0]))


def test_learns_marked_words_and_gives_their_offsets():
    clean = [f"good words {i} are here and there" for i in range(60)]
    toxic = [f"good words {i} you idiot are here" for i in range(60)]
    sample = Sample(clean + toxic, np.array([0] * 60 + [1] * 60), np.ones(120))
    model = train_chain(sample)
    odds = model.marginals(["some words and an IDIOT! here", "some words and there"])
    assert odds[0].argmax() == 4 and odds[0][4] > 0 and odds[1].max() < 0


def test_held_out_documents(spark):
    rows = LLM_QUERIES["op6_toxicity"](spark, FOLDER).toPandas()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas()
    assert len(rows) == 1000 and rows.score.between(0, 1).all()
    assert (rows.predicted == (rows.score >= 0.7)).all()
    held = rows[rows.held_out].merge(labels, on="doc_id")
    assert auc(held.toxic, held.score) > 0.88
    assert (held.predicted == held.toxic).mean() > 0.94


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    train = fold_of("doc_id", 3) != 1
    turned = labels.selectExpr("doc_id", "quality", "if(pmod(crc32(cast(doc_id as string)), 3) = 1, 1 - toxic, toxic) AS toxic")
    scores = [score_toxicity(docs, train_toxicity(docs, t, train)).orderBy("doc_id").select("score").collect() for t in (labels, turned)]
    assert scores[0] == scores[1]


def test_awkward_rows(spark):
    df = clashing(documents(spark))
    labels = spark.createDataFrame([(1, None), (2, 0), (5, 1), (5, 0), (7, 1), (8, 0), (None, 1)], "doc_id long, toxic int")
    model = train_toxicity(df, labels, fold_of("doc_id", 3) != 99)
    scored = score_toxicity(df, model).collect()
    assert len(scored) == len(ROWS) and all(0 <= r.score <= 1 for r in scored)
    none = train_toxicity(df, labels.limit(0), fold_of("doc_id", 3) != 1)
    assert {r.score for r in score_toxicity(df, none).collect()} == {0.5}
    assert score_toxicity(documents(spark, []), model).collect() == []
    assert drop_toxic(df, ToxicModel(), 0.4).collect() == []
    kept = drop_toxic(df, ToxicModel(), 0.6)
    assert kept.columns == df.columns and kept.count() == len(ROWS)


def log_likelihood(e, tags, mask, weight, steps):
    """Of padded windows, with every tagging written out."""
    total = 0.0
    for row in range(len(e)):
        n = int(mask[row].sum())
        score = lambda ys: sum(x for x, y in zip(e[row], ys) if y) + sum(steps[a, b] for a, b in zip(ys, ys[1:]))
        every = [score(ys) for ys in itertools.product((0, 1), repeat=n)]
        total += weight[row] * (score(tags[row][:n].tolist()) - math.log(sum(map(math.exp, every))))
    return total


def test_gradients_like_differences_of_the_likelihood():
    random = np.random.default_rng(3)
    e, steps, weight = random.normal(size=(4, 5)), random.normal(size=(2, 2)), np.array([1.0, 0.5, 2.0, 1.0])
    mask = np.arange(5) < np.array([[5], [3], [1], [4]])
    tags = np.where(mask, random.integers(0, 2, (4, 5)), -1)
    forward, backward = _passes(e, mask, steps)
    step = 1e-6
    by_token = np.where(mask, weight[:, None] * (tags - _sigmoid(forward + backward)), 0.0)
    for at in np.argwhere(mask):
        more, less = e.copy(), e.copy()
        more[tuple(at)] += step
        less[tuple(at)] -= step
        slope = (log_likelihood(more, tags, mask, weight, steps) - log_likelihood(less, tags, mask, weight, steps)) / (2 * step)
        assert abs(slope - by_token[tuple(at)]) < 1e-6
    pairs = _pair_gap(tags, mask, weight[:, None], e, forward, backward, steps)
    for at in np.ndindex(2, 2):
        more, less = steps.copy(), steps.copy()
        more[at] += step
        less[at] -= step
        slope = (log_likelihood(e, tags, mask, weight, more) - log_likelihood(e, tags, mask, weight, less)) / (2 * step)
        assert abs(slope - pairs[at]) < 1e-6


def test_windows_are_spread_over_the_length_of_a_text():
    """Also of a toxic one: twenty of its windows are marked, the last ones as well as the first."""
    filler = [f"plain{i % 40}" for i in range(WINDOW)]
    clean = [" ".join(filler)] * 30 + [" ".join(filler * 20)]
    toxic = [" ".join((filler[:-1] + ["zzidiot"]) * 20)] + [" ".join([*filler, "zzidiot"])] * 20
    sample = Sample(clean + toxic, np.array([0] * len(clean) + [1] * len(toxic)), np.ones(len(clean) + len(toxic)))
    labels = label_tokens(sample)
    assert [int(t.sum()) for t in labels] == [0] * 31 + [20] + [1] * 20
    x, y, _ = _windows(sample)
    assert len(x) == 30 + TEXT_WINDOWS + TEXT_WINDOWS + 20
    assert int((y == 1).sum()) == TEXT_WINDOWS + 20
    late = Sample([" ".join(filler * 20 + ["zzidiot"])] * 20 + clean, np.array([1] * 20 + [0] * len(clean)), np.ones(20 + len(clean)))
    assert int((_windows(late)[1] == 1).sum()) == 20


def test_scores_and_spans_like_plain_steps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = train_toxicity(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), fold_of("doc_id", 3) != 1)
    texts = {r.doc_id: r.text for r in docs.collect()}
    some = 0
    for row in score_toxicity(docs, model).collect():
        tokens = [(m.start(), m.end()) for m in re.finditer(r"\S+", texts[row.doc_id]) if m.group().split() == [m.group()]]
        words = [texts[row.doc_id][a:b] for a, b in tokens]
        if words != texts[row.doc_id].split():
            continue
        odds = chain_log_odds([np.array([model.emission(w) for w in words])], model.steps)[0]
        p = 1 / (1 + np.exp(-odds))
        z = model.beta[0] + model.beta[1] * math.log(p.sum() + 1e-4) + model.beta[2] * min(max(odds.max(), -15.0), 15.0)
        assert abs(row.score - 1 / (1 + math.exp(-z))) < 1e-6
        spans = []
        for k, q in enumerate(p):
            if q > 0.5 and spans and spans[-1][3] == k - 1:
                spans[-1][1:] = [tokens[k][1], min(spans[-1][2], q), k]
            elif q > 0.5:
                spans.append([*tokens[k], q, k])
        assert [(s.start, s.end) for s in row.spans] == [(a, b) for a, b, _, _ in spans]
        assert np.allclose([s.probability for s in row.spans], [q for _, _, q, _ in spans])
        some += len(spans)
    assert some > 5
