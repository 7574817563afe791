import hashlib
import random
import re

from scholium.llm.pii import digest_spans, find_pii
from scholium.llm.queries import LLM_QUERIES
from tests.llm.frames import FOLDER, ROWS, clashing, documents

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    worth = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(w - 9 if w > 9 else w for w in worth) % 10 == 0


def accepted(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text):
    found = [
        (m.start(), rank, f"{kind}:{m.start()}:{m.end()}")
        for rank, (kind, pattern) in enumerate(PATTERNS.items())
        for m in re.finditer(pattern, text)
        if accepted(kind, m.group())
    ]
    return [span for _, _, span in sorted(found)]


def compare(df, rows):
    got = {row.doc_id: row for row in digest_spans(find_pii(df)).collect()}
    for i, text in rows:
        base = base_spans(text or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), text[:200]
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [
            sum(s.startswith(k + ":") for s in base) for k in PATTERNS
        ]
        assert set(base) <= set(got[i].spans.split(","))
    return got


def test_base_spans_of_documents_and_nothing_else_there(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = compare(docs, rows)
    assert all(got[i].spans == ",".join(base_spans(text)) for i, text in rows)
    assert LLM_QUERIES["op3_pii"](spark, FOLDER).count() == len(rows)


def test_base_spans_of_random_texts(spark):
    random.seed(3)
    bits = "a b . @ 1 2 9 0 + - ( ) _ é 🙂 % 25 256 x.y A@b.c 1.2.3.4 4111111111111111".split() + [" ", "\n", "+1 (017) 555-7713"]
    rows = [(i, "".join(random.choice(bits) for _ in range(random.randint(0, 30)))) for i in range(1500)]
    rows += [(5000, "a" * 50_000 + "1" * 50_000 + ".1" * 20_000 + "@b" + ".c" * 50_000), (5001, None), (5002, "")]
    compare(documents(spark, rows), rows)


def test_checksums_and_context_decide_the_added_kinds(spark):
    rows = [
        (1, "pay DE89 3704 0044 0532 0130 00 now"), (2, "pay DE89 3704 0044 0532 0130 01 now"), (3, "GB82WEST12345698765432"),
        (4, "please call 555-123-4567 today"), (5, "item 555-123-4567 in stock"),
    ]
    got = {r.doc_id: r.spans for r in digest_spans(find_pii(documents(spark, rows))).collect()}
    assert got == {1: "iban:4:31", 2: "", 3: "iban:0:22", 4: "local_phone:12:24", 5: ""}


def test_awkward_rows(spark):
    found = find_pii(clashing(documents(spark))).collect()
    assert len(found) == len(ROWS)
    assert [s.kind for r in found if r.doc_id == 8 for s in r.spans] == ["phone", "email"]
    assert find_pii(documents(spark, [])).collect() == []


def test_no_python_in_the_plan(spark):
    plan = digest_spans(find_pii(documents(spark)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
