import hashlib
from collections import defaultdict

import pytest

from scholium.llm.exact_dedup import drop_copies, exact_dedup
from scholium.llm.queries import LLM_ORACLES, LLM_QUERIES
from tests.llm.frames import FOLDER, ROWS, clashing, documents, rows_of
from tests.oracle import differences


def lower(text):
    return (text or "").encode().lower().decode()


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[lower(text)].append(i)
    out, taken = [], set()
    for i, text in rows:
        ids = groups[lower(text)]
        keep = max((x for x in ids if x is not None), default=None)
        stays = i == keep and lower(text) not in taken
        if stays:
            taken.add(lower(text))
        out.append((i, keep, len(ids), stays, hashlib.sha256(lower(text).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("key_bytes", [32, 1, 0])
def test_like_brute_force_even_if_digests_collide(spark, key_bytes):
    rows = ROWS + [(100 + i, "hot text") for i in range(500)] + [(1000 + i, f"text {i}") for i in range(300)]
    assert rows_of(exact_dedup(documents(spark, rows), key_bytes=key_bytes)) == brute(rows)


def test_other_columns_do_not_matter(spark):
    assert rows_of(exact_dedup(clashing(documents(spark)))) == brute(ROWS)


def test_empty_table(spark):
    assert exact_dedup(documents(spark, [])).collect() == []
    assert drop_copies(documents(spark, [])).collect() == []


def test_drop_copies_keeps_one_whole_row_of_each_text(spark):
    df = clashing(documents(spark))
    kept = drop_copies(df)
    assert kept.columns == df.columns
    want = sorted([(r[0], r[4]) for r in brute(ROWS) if r[3]], key=repr)
    got = [(r.doc_id, hashlib.sha256(lower(r.text).encode()).hexdigest()) for r in kept.collect()]
    assert sorted(got, key=repr) == want


def test_same_rows_as_sql(spark):
    problems, rows, _ = differences(spark, FOLDER, "op1_exact_dedup", LLM_QUERIES, LLM_ORACLES)
    assert not problems and rows == 200
