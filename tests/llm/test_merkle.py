import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from scholium.llm import merkle
from scholium.llm.merkle import BLOCK, FAN, PathTree, digest, levels_above, lowercased, merkle_manifest
from scholium.llm.queries import LLM_ORACLES, LLM_QUERIES
from tests.llm.frames import FOLDER, LONG, SCHEMA, clashing, documents
from tests.oracle import differences

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, place):
    for level in levels[:-1]:
        start = place // 16 * 16
        yield level[start:place], level[place + 1 : start + 16]
        place //= 16


def brute(rows, tampers):
    """Whole trees in plain Python; rows are (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0], leaf_of(row), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[name] = climb([leaf for _, leaf, _ in groups[name]])
    top = climb([trees[name][-1][0] for name in names])
    out = []
    for g, name in enumerate(names):
        for place, (doc_id, leaf, row) in enumerate(groups[name]):
            folded, proof = leaf, []
            if tampers(doc_id):
                folded = leaf_of([*row[:4], row[4] and row[4].encode().lower().decode()])
            for before, after in [*siblings(trees[name], place), *siblings(top, g)]:
                proof += before + after
                folded = sha(*before, folded, *after)
            root = top[-1][0]
            out.append((doc_id, leaf, trees[name][-1][0], root, sha(*proof), folded, folded == root))
    return sorted(out, key=repr)


def fifth(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def got(df, **options):
    changed = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = merkle_manifest(df, {"text": lowercased("text")}, changed, outputs=("proof_sha256", "folded_root"), **options)
    return sorted(map(tuple, rows.collect()), key=repr)


@given(st.integers(1, 600), st.data())
@settings(max_examples=60, deadline=None)
def test_versions_share_all_but_their_ancestors(count, data):
    nodes = [digest((str(i),)) for i in range(count)]
    tree = PathTree(nodes, levels_above(count))
    before = [list(level) for level in tree.levels]
    place = data.draw(st.integers(0, count - 1))
    changed = [*nodes[:place], digest(("other",)), *nodes[place + 1 :]]
    version = tree.version(place, changed[place])
    want = climb(changed)
    assert tree.levels == before == climb(nodes)
    assert len(version.copied) == len(want) - 1
    for level in range(1, len(want)):
        assert [version.node(level, i) for i in range(len(want[level]))] == want[level]
    assert [o for _, o in tree.beside(place)] == ["".join(b + a) for b, a in siblings(before, place)]


@given(st.integers(BLOCK + 1, 3 * BLOCK), st.data())
@settings(max_examples=20, deadline=None)
def test_a_version_goes_on_above_its_block(count, data):
    nodes = [digest((str(i),)) for i in range(count)]
    whole = PathTree(nodes, levels_above(count))
    place = data.draw(st.integers(0, count - 1))
    first = place // BLOCK * BLOCK
    block = PathTree(nodes[first : first + BLOCK], 2)
    above = PathTree(whole.levels[2], levels_above(count) - 2).beside(place // BLOCK)
    other = digest(("other",))
    want = whole.version(place, other).copied
    assert block.version(place - first, other).continued(other, above) == want


def test_query_like_sql(spark):
    problems, rows, _ = differences(spark, FOLDER, "op11_merkle", LLM_QUERIES, LLM_ORACLES)
    assert not problems
    assert rows == 200


@pytest.mark.parametrize("counts", [{"a": 1}, {"a": 17, None: 1}, {"a": 5000, "B": 300, "é": 16, None: 40}, {f"s{i}": 1 for i in range(300)} | {"": 257}])
def test_like_whole_trees(spark, counts):
    draw = random.Random(1)
    rows = [(draw.randrange(10**9), name, draw.choice(["de", None]), i, f"Text {i} Ä") for name, count in counts.items() for i in range(count)]
    draw.shuffle(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")) == brute(rows, fifth)


AWKWARD = [
    (5, "A", "src0"), (5, "A", "src0"), (5, "B", "src0"), (None, None, None), (None, "X", "src0"), (7, LONG + "Q", "src1"), (8, "", "src1"),
    (9, " ".join(f"Word{i}" for i in range(40_000)), "src1"), *[(6, "Same", "src2")] * 700,
]


def test_awkward_rows_and_clashing_columns(spark):
    rows = [(i, source, None, len(text or ""), text) for i, text, source in AWKWARD]
    frame = spark.createDataFrame([(i, t, lang, s, n) for i, s, lang, n, t in rows], SCHEMA)
    for name in ("_node", "_tree", "_at", "leaf", "root", "proof"):
        frame = frame.withColumn(name, F.lit("x"))
    assert got(clashing(frame)) == brute(rows, fifth)
    assert got(documents(spark, [])) == []


def test_proofs_and_copied_nodes(spark):
    """The proof of a leaf folds to the root, and the nodes of its version to the version's root."""
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = merkle_manifest(df, {"text": lowercased("text")}, F.lit(True)).collect()
    assert {c for r in rows for c in [len(r.copied) - len(r.proof)]} == {0}
    assert all(r.verified == (r.copied[-1] == r.root) for r in rows)
    assert any(r.verified for r in rows) and not all(r.verified for r in rows)
    untouched = merkle_manifest(df).collect()
    assert all(r.verified and r.copied[-1] == r.root for r in untouched)
    assert all(len(others) <= (FAN - 1) * merkle.HEX for r in untouched for others in r.proof)
