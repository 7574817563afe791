import html
import re

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings as hypothesis_settings, strategies as st

from scholium.llm.html_blocks import (
    _TOKEN, HIDDEN_SIZE, INPUT_SIZE, Labeller, _backward, _forward, block_vectors, extract_text, main_text, parse_blocks,
    teaching_pages, train_html, train_labeller, training_pages, weak_labels,
)
from scholium.llm.queries import LLM_QUERIES
from tests.llm.frames import clashing

FOLDER = "/root/testdata/sf0.01"


def article(page):
    """What stands between the article tags, by paragraph; right for the test pages only."""
    inside = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = [re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", part)) for part in re.split(r"</?(?:p|h1)>", inside)]
    texts = [" ".join(html.unescape(b).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)


def test_query_finds_the_article_of_every_page(spark):
    pages = pq.read_table(f"{FOLDER}/pages.parquet").to_pandas().set_index("page_id")
    rows = LLM_QUERIES["op9_html_text"](spark, FOLDER).collect()
    assert len(rows) == len(pages)
    for row in rows:
        assert row.text == article(pages.html[row.page_id]) and row.n_chars == len(row.text)
        assert row.url == pages.url[row.page_id]


def test_pages_that_were_never_learned_from(spark):
    """Trained on the pages of even ids, judged on the others."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    model = train_html(pages.where("page_id % 2 = 0"))
    held = pages.where("page_id % 2 = 1 AND page_id < 800")
    texts = {r.page_id: r.html for r in held.collect()}
    rows = extract_text(held, model).collect()
    assert len(rows) == len(texts) > 300
    assert np.mean([row.text == article(texts[row.page_id]) for row in rows]) > 0.99


def test_other_dress_than_the_sampled_pages():
    pages = pq.read_table("/root/testdata/sf0.1/pages.parquet").column("html").to_pylist()
    model = train_labeller(training_pages(pages[:150]))
    held = training_pages(pages[1500:1600], seed=77)
    right = np.concatenate([(p >= 0.5) == y for p, (_, y) in zip(model.probabilities([v for v, _ in held]), held)])
    assert right.mean() > 0.99


def test_blocks():
    page = (
        "<!DOCTYPE html><title>T</title><body><!-- <p>no</p> --><p>one <b>tw</b>o<br>three&nbsp;&amp; four"
        "<p>five<ul><li>six<li><a href='x>y'>seven</a></ul><script>if (a < b) '<p>'</script>5 < 6 <div/>end</body"
    )
    blocks = parse_blocks(page)
    assert [b.text for b in blocks][:5] == ["one two three & four", "five", "six", "seven", "5 < 6"]
    assert blocks[3].linked == 5 and [t for t, _ in blocks[2].path] == ["body", "p", "ul", "li"]
    assert parse_blocks("") == [] and parse_blocks("<p>  </p><script>x") == []
    assert [b.text for b in parse_blocks("<" * 2000)] == ["<" * 2000]


def test_pages_without_end_of_head_in_a_form_or_behind_an_open_part():
    pages = pq.read_table(f"{FOLDER}/pages.parquet").column("html").to_pylist()
    model = train_labeller(training_pages(pages))

    def text(page):
        blocks = parse_blocks(page)
        assert weak_labels(blocks) is not None
        return main_text(blocks, model.probabilities([block_vectors(blocks)])[0])

    changes = {
        "head": lambda p: re.sub("</head>", "", p),
        "head and body": lambda p: re.sub("</head>|</?body[^>]*>", "", p),
        "form": lambda p: re.sub("(<body[^>]*>)", r"\1<form id='aspnetForm'>", p).replace("</body>", "</form></body>"),
        "open form": lambda p: re.sub("(<body[^>]*>)", r"\1<form>", p),
        "open nav": lambda p: p.replace("</nav>", ""),
    }
    for name, change in changes.items():
        changed = [change(p) for p in pages[:40]]
        assert changed != pages[:40], name
        right = sum(text(c) == article(p) for c, p in zip(changed, pages))
        assert right >= 38, (name, right)


def test_few_teaching_pages_among_many(spark):
    pages = pq.read_table(f"{FOLDER}/pages.parquet").column("html").to_pylist()
    bare = "<body><nav><p>menu</p></nav><div class='x'><p>No article is marked here.</p></div></body>"
    # 120 of 6,000 rows teach; one id has 3,000 rows, of which only some teach.
    rows = [(i, "u", pages[i]) for i in range(119)] + [(i, "u", bare) for i in range(1000, 3880)]
    rows += [(7000, "u", bare)] * 3000 + [(7000, "u", pages[119])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = df.selectExpr("page_id AS _id", "html AS _html")
    assert {r._id for r in teaching_pages(texts).collect()} == {*range(119), 7000}
    model = train_html(df)
    blocks = [parse_blocks(p) for p in pages[120:]]
    odds = model.probabilities([block_vectors(b) for b in blocks])
    right = sum(main_text(b, o) == article(p) for b, o, p in zip(blocks, odds, pages[120:]))
    assert model.taught and right >= 0.95 * len(blocks)


def test_rule_where_no_page_teaches(spark):
    page = "<nav><p>menu</p></nav><div class='x'><p>The text.</p><script>no</script></div><div class='comments'>me too</div>"
    df = spark.createDataFrame([(1, "u", page), (2, "v", "plain")], "page_id long, url string, html string")
    model = train_html(df)
    assert not model.taught
    assert {r.page_id: r.text for r in extract_text(df, model).collect()} == {1: "The text.", 2: "plain"}


def test_gradients_like_differences():
    random = np.random.default_rng(3)
    model = Labeller.fresh(1)
    x, mask = random.normal(size=(2, 5, INPUT_SIZE)), np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0.0]])
    target = random.normal(size=(2, 5, HIDDEN_SIZE))

    def loss():
        states, _ = _forward(x, mask, model.forward)
        return (mask[:, :, None] * states * target).sum()

    _, tape = _forward(x, mask, model.forward)
    for name, gradient in zip(("x", "h", "b"), _backward(x, mask[:, :, None] * target, tape, model.forward)):
        weights = model.forward[name].reshape(-1)
        for i in random.integers(0, weights.size, 6):
            before = weights[i]
            weights[i] = before + 1e-6
            up = loss()
            weights[i] = before - 1e-6
            down = loss()
            weights[i] = before
            assert abs((up - down) / 2e-6 - gradient.reshape(-1)[i]) < 1e-5


def test_batch_like_single_pages():
    pages = pq.read_table(f"{FOLDER}/pages.parquet").column("html").to_pylist()[:8]
    model = Labeller.fresh(2)
    vectors = [block_vectors(parse_blocks(p)) for p in pages] + [np.zeros((0, INPUT_SIZE))]
    for one, many in zip([model.probabilities([v])[0] for v in vectors], model.probabilities(vectors)):
        assert np.allclose(one, many)


def test_awkward_rows(spark):
    page = "<article><p>" + "word " * 30 + "</p></article>"
    rows = [(1, "u", None), (None, None, page), (2, "v", ""), (2, "v", ""), (3, "w", "<p>" * 3000 + "x" * 200_000), (4, "z", "plain text")]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string")).selectExpr("*", "'a' AS _html")
    model = train_html(df)
    got = extract_text(df, model).collect()
    assert len(got) == len(rows) and {r.text for r in got if r.page_id in (1, 2)} == {""}
    assert extract_text(df.limit(0), model).collect() == []
    assert extract_text(df, train_html(df.limit(0))).count() == len(rows)
    assert main_text([], np.zeros(0)) == ""


def end_of_tag(page, at):
    """Where a tag ends whose attributes begin at ``at``, state by state as the HTML standard has it; None if a quote stays open."""
    state, end = "before name", len(page)
    while at < end:
        c = page[at]
        if state == "before name":
            if c == ">":
                return at + 1
            if not (c.isspace() or c == "/"):
                state = "name"
        elif state in ("name", "after name"):
            if c == ">":
                return at + 1
            if c == "=":
                state = "before value"
            elif c == "/":
                state = "before name"
            elif c.isspace():
                state = "after name"
            elif state == "after name":
                state = "name"
        elif state == "before value":
            if c == ">":
                return at + 1
            if c in "\"'":
                close = page.find(c, at + 1)
                if close < 0:
                    return None
                at, state = close, "before name"
            elif not c.isspace():
                state = "value"
        elif state == "value":
            if c == ">":
                return at + 1
            if c.isspace():
                state = "before name"
        at += 1
    return None


@given(st.text(alphabet="ab=\"'/ >", max_size=25))
@hypothesis_settings(max_examples=3000, deadline=None)
def test_tags_end_where_html_ends_them(attributes):
    page = f"<p {attributes}>text</p>"
    end = end_of_tag(page, 2)
    if end is not None:
        assert _TOKEN.match(page).end() == end


def test_stray_quotes_lose_and_leak_nothing():
    page = '<article><p title="5" tall">Hello world</p><p data-x=it\'s>Third</p><p>Fourth it\'s</p><p alt=\'a>b\' c="d>e">Fifth</p></article>'
    assert [b.text for b in parse_blocks(page)] == ["Hello world", "Third", "Fourth it's", "Fifth"]
    assert [b.text for b in parse_blocks("<script data-x=it's>no</script><p>yes's</p>")] == ["yes's"]
    assert [b.text for b in parse_blocks("<p>a</p><scripture x=\"y\">b</scripture>")] == ["a", "b"]


def test_a_stray_quote_in_a_page_changes_nothing():
    for page in pq.read_table(f"{FOLDER}/pages.parquet").column("html").to_pylist():
        for dressed in (page.replace("<p>", "<p data-x=it's>", 1), page.replace("<p>", '<p title="5" tall">', 1)):
            assert parse_blocks(dressed) == parse_blocks(page)
