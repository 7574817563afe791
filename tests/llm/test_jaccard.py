import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from scholium.llm import jaccard_join, texts
from scholium.llm.components import components
from scholium.llm.jaccard_join import (
    bitmap, drop_similar, folded, linked, may_link, prefix_size, shingle_set, shingle_sets, similar_documents,
)
from scholium.llm.queries import LLM_QUERIES
from tests.llm.frames import ROWS, clashing, documents, rows_of


def brute(rows):
    """Every pair that shares a shingle, by counting."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in having[x])
        for x in s:
            having[x].append(i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted([(d, len(s), (least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets))], key=repr)


def near_copies():
    """Chains, a large group of near copies, one passage in many texts, and exact copies."""
    pick = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    passage = pick.choices(words, k=40)
    rows = []

    def edited(text, n):
        text = list(text)
        for _ in range(n):
            text[pick.randrange(len(text))] = pick.choice(words)
        return text

    base = pick.choices(words, k=80)
    rows += [edited(base, pick.choice([0, 1, 2])) for _ in range(150)]
    chain = pick.choices(words, k=60)
    for _ in range(25):
        rows.append(chain)
        chain = edited(chain, 1)
    for _ in range(120):
        text = pick.choices(words, k=pick.choice([4, 12, 30]))
        rows += [passage + text, passage + edited(text, 1)]
    rows += [["copy", "of", "few"]] * 40 + [passage] * 3 + [pick.choices(words, k=n) for n in range(1, 12)]
    ids = list(range(len(rows)))
    pick.shuffle(ids)
    return [(i, " ".join(r)) for i, r in zip(ids, rows)]


@pytest.mark.parametrize(
    "first, tile, common, lead, small", [(8, 256, 4, 32, 16), (0, 3, 4, 1, 2), (8, 256, 10**9, 32, 300), (0, 64, 10**9, 4, 1)]
)
def test_like_brute_force_by_stars_and_by_tiles(spark, monkeypatch, first, tile, common, lead, small):
    monkeypatch.setattr(jaccard_join, "LEAD", lead)
    monkeypatch.setattr(jaccard_join, "SMALL_TILE", small)
    monkeypatch.setattr(jaccard_join, "FIRST", first)
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "COMMON", common)
    rows = near_copies()
    assert rows_of(similar_documents(documents(spark, rows))) == brute(rows)


def test_query_on_whole_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert rows_of(LLM_QUERIES["op10_jaccard"](spark, folder)) == brute(rows)


def test_awkward_rows(spark):
    assert rows_of(similar_documents(clashing(documents(spark)))) == brute(ROWS)
    assert similar_documents(documents(spark, [])).collect() == []


def test_drop_similar_keeps_one_row_of_each_component(spark):
    rows = near_copies() + [(5000, ""), (5001, None), (5002, " "), (7, "some other text of this id"), (7, "some other text of this id")]
    df = clashing(documents(spark, rows))
    kept = drop_similar(df)
    assert kept.columns == df.columns
    expected = [d for d, n, name in brute(rows[:-2]) if d == name]
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*expected, 7])
    assert drop_similar(documents(spark, [])).collect() == []


def test_shingles_of_a_batch_like_those_of_each_text():
    """Words end at the six ASCII white spaces alone, A-Z alone are lowered, and no shingle reaches into the next text."""
    texts = ["", "  ", "One", " a  b\tc\nd\x0be\x0cf\rg ", "a b c d", "É é A\xa0b \x1c c d e", "A B C D e f", "x " * 50]
    for text, found in zip(texts, shingle_sets(pa.array(["pad pad pad", *texts, "pad"]).slice(1, len(texts)))):
        words = text.encode().lower().split()
        want = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        assert len(found) == len(want) and (np.diff(found.astype(object)) > 0).all()
        assert (found == shingle_set(text)).all()
    assert (shingle_set("a b c d e") == shingle_set("A  B\tC D E")).all() and (shingle_set("a b c d") != shingle_set("a b c e")).all()
    assert set(shingle_set("a b c d e f")) & set(shingle_set("z b c d e f"))
    assert shingle_sets(pa.array([], pa.string())) == []


def test_bounds_never_lose_a_link():
    pick = random.Random(9)
    words = [f"v{i}" for i in range(400)]
    for _ in range(300):
        text = pick.choices(words, k=pick.randint(1, 90))
        other = list(text)
        for _ in range(pick.randint(0, 8)):
            other[pick.randrange(len(other))] = pick.choice(words)
        x, y = shingle_set(" ".join(text)), shingle_set(" ".join(other[: pick.randint(max(1, len(other) - 15), len(other))]))
        if linked(x, y):
            a, b = bitmap(x), bitmap(y)
            width = min(len(a), len(b))
            apart = bin(int.from_bytes((folded(a, width) ^ folded(b, width)).tobytes(), "little")).count("1")
            assert may_link(len(x), len(y), apart)
            assert set(x[: prefix_size(len(x))]) & set(y[: prefix_size(len(y))])


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}


def test_a_pair_comes_up_once_for_many_shared_hashes(spark, monkeypatch):
    """Texts that share most shingles but too few to be linked: as many pairs as there are, not one per shared hash."""
    pick = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(12):
        text = list(base)
        for place in range(k % 4 * 3, 120, 24):  # each edit breaks five of 116 shingles
            text[place] = f"x{k}-{place}"
        texts.append(" ".join(text))
    found = []
    monkeypatch.setattr(jaccard_join, "FIRST", 0)
    plain = jaccard_join._tile_pairs
    monkeypatch.setattr(jaccard_join, "_tile_pairs", lambda *a: found.append(plain(*a)) or found[-1])
    rows = list(enumerate(texts))
    assert rows_of(similar_documents(documents(spark, rows))) == brute(rows)
    tiles = found[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in tiles and found[0].count() <= 66


def test_tasks_drop_other_caches_and_take_bounded_slices(monkeypatch):
    """Workers are reused: what the stage before remembered must not stay beside the sets; few long texts are a slice too."""
    monkeypatch.setattr(texts, "_caches", {})
    kept = {"word": 1}
    texts.task_cache("bpe", kept.clear)
    long = "x" * (texts.SLICE_BYTES // 2)
    rows = pa.record_batch([pa.array(range(700)), pa.array([long] * 5 + ["y"] * 695)], ["id", "text"])
    sizes = [part.num_rows for part in jaccard_join._slices(iter([rows]), 1)]
    assert not kept and sum(sizes) == 700
    assert sizes[:2] == [2, 2] and max(sizes) <= jaccard_join.SLICE_ROWS


def test_wide_rows_travel_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows])], ["n"])

    rows = spark.range(0, 4000, 1, 2).mapInArrow(sizes, "n long")
    written = jaccard_join._written(rows, "sizes")
    assert sum(r.n for r in written.collect()) == 4000
    assert max(r.n for r in written.collect()) <= jaccard_join.SLICE_ROWS and spark.conf.get(name) == before
