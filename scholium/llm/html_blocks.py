"""Main text of web pages by a recurrent labeller of text blocks.

A page is cut into blocks: the text between two block-level tags, with the path of elements it stands in. Each block
becomes a vector of its hashed path (tags, class and id words), its hashed words and a few measures. A bidirectional
LSTM reads all blocks of a page, so every decision sees the whole page. It is trained here, in numpy, on a bounded
sample of pages that mark their article with tags of HTML itself. Every sampled page is also shown in other dress:
other tags and class names for the same parts, and parts that pages have elsewhere, such as reader comments.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.labelled import first_by_hash
from scholium.llm.texts import field_type, filled, schema
from scholium.plans import scratch_dir

# How HTML treats its elements.
HIDDEN = set("script style noscript template head title svg iframe textarea canvas".split())  # never article text
RAW = ["script", "style", "textarea", "title", "noscript", "iframe"]
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt s samp small span "
    "strike strong sub sup time tt u var".split()
)
# Elements that end an open paragraph or item of their own kind.
CLOSES_OWN = {"p": "p", "li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
# What may stand in head; anything else ends it, as its end tag may be left out.
IN_HEAD = set("base link meta title style script noscript template".split())
# Elements that are not the article in the weak labels; elsewhere the labeller decides.
ASIDE_TAGS = set("nav footer aside form menu dialog object select option button".split())
# Of these, elements that may be left open, or stand around a whole page.
WRAPPERS = set("nav footer aside form menu dialog".split())
ARTICLE_TAGS = {"article", "main"}
# Class and id words of parts that are not the article.
ASIDE_WORDS = set(
    "ad ads advert advertisement banner breadcrumb comment comments consent cookie cookies disqus footer gdpr login "
    "masthead menu nav navbar navigation newsletter notice pager pagination popup promo recommended related replies "
    "reply respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar topbar widget".split()
)

# Attributes of a tag. A quote opens a value only directly behind the equals sign; elsewhere it is part of a name or of a
# value without quotes, which white space or the end of the tag ends.
_VALUE = r"\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+)"
_ATTRIBUTES = rf"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:{_VALUE})?+)*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s/>]){_ATTRIBUTES}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{_ATTRIBUTES})>"
    r"|<[!?/][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTRS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z0-9]+")

PATH_SIZE, WORD_SIZE, MEASURES, HIDDEN_SIZE = 64, 48, 8, 16
INPUT_SIZE = PATH_SIZE + WORD_SIZE + MEASURES
SAMPLE_PAGES = 240
EPOCHS = 6

Path = tuple[tuple[str, tuple[str, ...]], ...]


@dataclass
class Block:
    path: Path
    text: str
    linked: int  # characters inside links


def parse_blocks(page: str) -> list[Block]:
    """Blocks with text, in page order. Unclosed and stray tags are forgiven, wrappers of the page left out."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    blocks: list[Block] = []
    parts: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            blocks.append(Block(tuple(stack), text, min(linked, len(text))))
        parts.clear()
        linked = 0

    for token in _TOKEN.finditer(page):
        kind = token.lastgroup
        if kind == "text":
            if stack and stack[-1][0] == "head" and not token["text"].isspace():
                stack.pop()
            parts.append(token["text"])
            if links:
                linked += len(token["text"])
            continue
        if token["tag"] is None:
            if token["raw"] is None or token["raw"].lower() not in INLINE:
                parts.append("")
            continue
        tag = token["tag"].lower()
        if stack and stack[-1][0] == "head" and tag not in IN_HEAD and not token["close"]:
            flush()
            stack.pop()
        if tag == "br":
            parts.append("\n")
        if tag in VOID:
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if token["close"] else 1
            continue
        flush()
        links = 0
        if token["close"]:
            if any(open_tag == tag for open_tag, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        own = CLOSES_OWN.get(tag, "").split()
        while stack and stack[-1][0] in own:
            stack.pop()
        attrs = token["attrs"]
        words = ()
        if attrs and "=" in attrs:
            words = tuple(w for m in _ATTRS.finditer(attrs) for w in _WORDS.findall((m[1] or m[2] or m[3] or "").lower()))
        if not attrs.endswith("/"):
            stack.append((tag, words))
    flush()
    return see_through(blocks)


def see_through(blocks: list[Block]) -> list[Block]:
    """Without the wrappers that stand around the article: they tell nothing about what is inside.

    Such are a form around an article or main element or around more than half of the page's text, and a nav, footer,
    aside, menu or dialog around both, which was left open. Of each kind only the outermost is looked at.
    """
    held: dict[Path, list] = {}
    wraps: list[list[int]] = []
    for block in blocks:
        tags = [tag for tag, _ in block.path]
        wraps.append([tags.index(tag) for tag in WRAPPERS.intersection(tags)])
        for i in wraps[-1]:
            inside = held.setdefault(block.path[: i + 1], [0, False])
            inside[0] += len(block.text)
            inside[1] |= not ARTICLE_TAGS.isdisjoint(tags[i + 1 :])
    if not held:
        return blocks
    half = sum(len(b.text) for b in blocks) / 2
    clear = {path for path, (size, article) in held.items() if size > half and article or path[-1][0] == "form" and (size > half or article)}
    for block, at in zip(blocks, wraps):
        gone = {i for i in at if block.path[: i + 1] in clear}
        if gone:
            block.path = tuple(part for i, part in enumerate(block.path) if i not in gone)
    return blocks


def hidden(path: Path) -> bool:
    return any(tag in HIDDEN for tag, _ in path)


def aside_part(path: Path) -> bool:
    return any(tag in ASIDE_TAGS or tag in HIDDEN or any(w in ASIDE_WORDS for w in words) for tag, words in path)


def _bucket(text: str, size: int) -> int:
    return zlib.crc32(text.encode()) % size


_paths: dict[Path, np.ndarray] = {}
_hashes: dict[str, int] = {}


def path_vector(path: Path) -> np.ndarray:
    found = _paths.get(path)
    if found is None:
        found = np.zeros(PATH_SIZE, dtype=np.float32)
        for depth, (tag, words) in enumerate(path):
            found[_bucket("t:" + tag, PATH_SIZE)] += 1
            for word in words:
                found[_bucket("w:" + word, PATH_SIZE)] += 1
                if word in ASIDE_WORDS:
                    found[_bucket("aside", PATH_SIZE)] += 1
            if depth == len(path) - 1:
                found[_bucket("leaf:" + tag, PATH_SIZE)] += 1
        found = np.minimum(found, 2.0)
        if len(_paths) > 20_000:
            _paths.clear()
        _paths[path] = found
    return found


def _word_bucket(word: str) -> int:
    found = _hashes.get(word)
    if found is None:
        if len(_hashes) > 300_000:
            _hashes.clear()
        found = _hashes[word] = _bucket(word, WORD_SIZE)
    return found


def block_vectors(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), INPUT_SIZE), dtype=np.float32)
    for i, block in enumerate(blocks):
        out[i, :PATH_SIZE] = path_vector(block.path)
        words = block.text.lower().split()
        counts = np.bincount([_word_bucket(w) for w in words], minlength=WORD_SIZE)
        out[i, PATH_SIZE : PATH_SIZE + WORD_SIZE] = counts / np.sqrt(counts @ counts)
        size = len(block.text)
        out[i, PATH_SIZE + WORD_SIZE :] = (
            np.log1p(size) / 5,
            np.log1p(len(words)) / 4,
            block.linked / size,
            block.text.count(".") / (len(words) + 1) * 4,
            size / len(words) / 10,
            i / len(blocks),
            min(len(blocks), 100) / 100,
            len(block.path) / 10,
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Weights of the two directions and of the output; ``taught`` is false where no page marked an article."""

    forward: dict[str, np.ndarray] = field(default_factory=dict)
    backward: dict[str, np.ndarray] = field(default_factory=dict)
    out: np.ndarray = field(default_factory=lambda: np.zeros(2 * HIDDEN_SIZE + 1))
    taught: bool = True

    @staticmethod
    def fresh(seed: int) -> Labeller:
        random = np.random.default_rng(seed)

        def direction() -> dict[str, np.ndarray]:
            bias = np.zeros(4 * HIDDEN_SIZE)
            bias[HIDDEN_SIZE : 2 * HIDDEN_SIZE] = 1.0  # forget gates start open
            return {
                "x": random.normal(0, INPUT_SIZE**-0.5, (INPUT_SIZE, 4 * HIDDEN_SIZE)),
                "h": random.normal(0, HIDDEN_SIZE**-0.5, (HIDDEN_SIZE, 4 * HIDDEN_SIZE)),
                "b": bias,
            }

        return Labeller(direction(), direction(), random.normal(0, 0.1, 2 * HIDDEN_SIZE + 1))

    def parameters(self) -> list[np.ndarray]:
        return [*self.forward.values(), *self.backward.values(), self.out]

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Of each page, the probability of each block to be article text."""
        sizes = np.array([len(p) for p in pages], dtype=np.int64)
        if not sizes.sum():
            return [np.zeros(0) for _ in pages]
        flat = np.concatenate(pages)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        order = np.argsort(-sizes, kind="stable")
        starts_long, sizes_long = starts[order], sizes[order]
        states = []
        for weights, reverse in ((self.forward, False), (self.backward, True)):
            states.append(_walk(flat @ weights["x"] + weights["b"], weights["h"], starts_long, sizes_long, reverse))
        p = _sigmoid(np.hstack(states) @ self.out[:-1] + self.out[-1])
        return [p[s : s + n] for s, n in zip(starts, sizes)]


def _walk(inputs: np.ndarray, recurrent: np.ndarray, starts: np.ndarray, sizes: np.ndarray, reverse: bool) -> np.ndarray:
    """Hidden states of all blocks. Pages are walked side by side, the longest first."""
    n = HIDDEN_SIZE
    hidden = np.zeros((len(inputs), n))
    h, c = np.zeros((len(sizes), n)), np.zeros((len(sizes), n))
    for t in range(int(sizes[0])):
        live = int(np.searchsorted(-sizes, -t, side="left"))
        at = starts[:live] + (sizes[:live] - 1 - t if reverse else t)
        z = inputs[at] + h[:live] @ recurrent
        i, f, o = _sigmoid(z[:, :n]), _sigmoid(z[:, n : 2 * n]), _sigmoid(z[:, 2 * n : 3 * n])
        c = f * c[:live] + i * np.tanh(z[:, 3 * n :])
        h = o * np.tanh(c)
        hidden[at] = h
    return hidden


def _forward(x: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray]) -> tuple[np.ndarray, list]:
    """States of padded pages (pages, steps, inputs); a padded step keeps the state."""
    n, (pages, steps, _) = HIDDEN_SIZE, x.shape
    h, c = np.zeros((pages, n)), np.zeros((pages, n))
    states, tape = np.zeros((pages, steps, n)), []
    drive = x @ w["x"] + w["b"]
    for t in range(steps):
        z = drive[:, t] + h @ w["h"]
        i, f, o, g = _sigmoid(z[:, :n]), _sigmoid(z[:, n : 2 * n]), _sigmoid(z[:, 2 * n : 3 * n]), np.tanh(z[:, 3 * n :])
        m = mask[:, t, None]
        new_c = m * (f * c + i * g) + (1 - m) * c
        new_h = m * (o * np.tanh(new_c)) + (1 - m) * h
        tape.append((i, f, o, g, c, new_c, h, m))
        h, c = new_h, new_c
        states[:, t] = h
    return states, tape


def _backward(x: np.ndarray, grad: np.ndarray, tape: list, w: dict[str, np.ndarray]) -> list[np.ndarray]:
    n = HIDDEN_SIZE
    dz_all = np.zeros((*x.shape[:2], 4 * n))
    dh, dc = np.zeros_like(grad[:, 0]), np.zeros_like(grad[:, 0])
    dwh = np.zeros_like(w["h"])
    for t in range(x.shape[1] - 1, -1, -1):
        i, f, o, g, c, new_c, h, m = tape[t]
        dh = dh + grad[:, t]
        squashed = np.tanh(new_c)
        inner = m * (dc + dh * o * (1 - squashed**2))
        dz = np.hstack([inner * g * i * (1 - i), inner * c * f * (1 - f), m * dh * squashed * o * (1 - o), inner * i * (1 - g**2)])
        dz_all[:, t] = dz
        dwh += h.T @ dz
        dc = inner * f + (1 - m) * dc
        dh = dz @ w["h"].T + (1 - m) * dh
    flat = dz_all.reshape(-1, 4 * n)
    return [x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(0)]


def train_labeller(pages: list[tuple[np.ndarray, np.ndarray]], seed: int = 11, epochs: int = EPOCHS) -> Labeller:
    """Log loss of the block labels by Adam, pages of like length together."""
    model = Labeller.fresh(seed)
    pages = sorted([p for p in pages if len(p[1])], key=lambda p: len(p[1]))
    batches = [pages[i : i + 24] for i in range(0, len(pages), 24)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parameters()]
    random, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        for index in random.permutation(len(batches)):
            batch = batches[index]
            longest = max(len(y) for _, y in batch)
            x = np.zeros((len(batch), longest, INPUT_SIZE))
            y, mask = np.zeros((len(batch), longest)), np.zeros((len(batch), longest))
            for k, (vectors, labels) in enumerate(batch):
                x[k, : len(labels)], y[k, : len(labels)], mask[k, : len(labels)] = vectors, labels, 1.0
            ahead, tape = _forward(x, mask, model.forward)
            # Padding comes first when the page is read from its end; it leaves the state as it is.
            behind, tape_back = _forward(x[:, ::-1], mask[:, ::-1], model.backward)
            both = np.concatenate([ahead, behind[:, ::-1]], axis=2)
            gap = mask * (_sigmoid(both @ model.out[:-1] + model.out[-1]) - y) / mask.sum()
            grad = gap[:, :, None] * model.out[:-1]
            gradients = [
                *_backward(x, grad[:, :, :HIDDEN_SIZE], tape, model.forward),
                *_backward(x[:, ::-1], grad[:, ::-1, HIDDEN_SIZE:], tape_back, model.backward),
                np.append(np.einsum("pt,pth->h", gap, both), gap.sum()),
            ]
            step += 1
            for value, (mean, square), g in zip(model.parameters(), moments, gradients):
                g = np.clip(g, -1, 1)
                mean += 0.1 * (g - mean)
                square += 0.01 * (g**2 - square)
                value -= 0.01 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return model


# Other dress for the parts of a page: (tag, class words). Fixed values.
ARTICLE_DRESS = [
    ("article", ()), ("main", ()), ("div", ("content",)), ("div", ("post", "body")), ("section", ("story",)),
    ("div", ("entry",)), ("div", ("text",)), ("div", ("main",)), ("div", ("x1",)), ("td", ()),
]
MENU_DRESS = [("nav", ()), ("div", ("menu",)), ("div", ("navbar",)), ("header", ()), ("div", ("header",)), ("div", ("x2",))]
FOOT_DRESS = [("footer", ()), ("div", ("footer",)), ("div", ("copyright",)), ("div", ("bottom",))]
ADVERT_DRESS = [("div", ("ad",)), ("aside", ()), ("div", ("promo",)), ("div", ("sponsored",)), ("div", ("banner",))]
ADDED_DRESS = [
    ("section", ("comments",)), ("div", ("comment", "list")), ("aside", ("sidebar",)), ("div", ("sidebar",)),
    ("div", ("cookie", "notice")), ("div", ("consent",)), ("form", ()), ("div", ("newsletter",)), ("div", ("related",)),
    ("div", ("share",)), ("header", ("masthead",)), ("div", ("notice",)), ("div", ("widget",)), ("ul", ("breadcrumb",)),
]


def weak_labels(blocks: list[Block]) -> np.ndarray | None:
    """1 inside an article or main element and outside all aside parts; None where a page marks no article."""
    marked = np.zeros(len(blocks))
    for i, block in enumerate(blocks):
        marked[i] = any(tag in ARTICLE_TAGS for tag, _ in block.path) and not aside_part(block.path)
    return marked if marked.any() else None


def redress(blocks: list[Block], labels: np.ndarray, random: np.random.Generator, spare: list[str]) -> tuple[list[Block], np.ndarray]:
    """The same page with other tags and class names, and with one added part that is not the article."""
    pick = {"article": ARTICLE_DRESS, "main": ARTICLE_DRESS, "nav": MENU_DRESS, "footer": FOOT_DRESS}
    chosen = {tag: dress[random.integers(len(dress))] for tag, dress in pick.items()}
    advert = ADVERT_DRESS[random.integers(len(ADVERT_DRESS))]

    def swap(path: Path) -> Path:
        return tuple(chosen.get(tag, advert if tag == "div" and set(words) & ASIDE_WORDS else (tag, words)) for tag, words in path)

    new = [Block(swap(b.path), b.text, b.linked) for b in blocks]
    inside = np.flatnonzero(labels)
    part = ADDED_DRESS[random.integers(len(ADDED_DRESS))]
    # Added parts stand before the article, after it, or at its end.
    place = random.integers(3)
    at = inside[0] if place == 0 else inside[-1] + 1
    outer = new[inside[0]].path[: -1 if place < 2 else None]
    leaf = [("p", ()), ("div", ()), ("li", ())][random.integers(3)]
    root = tuple(p for p in outer if place == 2 or p != chosen["article"] and p != chosen["main"] and p[0] != "p")
    root = tuple(p for p in root if p[0] not in ("p", "h1"))
    texts = [spare[random.integers(len(spare))] for _ in range(1 + random.integers(4))] if spare else []
    added = [Block((*root, part, leaf), t, 0) for t in texts]
    return new[:at] + added + new[at:], np.concatenate([labels[:at], np.zeros(len(added)), labels[at:]])


def training_pages(pages: list[str], seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each sampled page as it is and in two other dresses."""
    random = np.random.default_rng(seed)
    parsed = [parse_blocks(page) for page in pages]
    marked = [(blocks, weak_labels(blocks)) for blocks in parsed]
    marked = [(blocks, labels) for blocks, labels in marked if labels is not None]
    spare = [b.text for blocks, _ in marked for b in blocks][:5000]
    out = []
    for blocks, labels in marked:
        out.append((block_vectors(blocks), labels))
        for _ in range(2):
            new, new_labels = redress(blocks, labels, random, spare)
            out.append((block_vectors(new), new_labels))
    return out


def teaching_pages(pages: DataFrame) -> DataFrame:
    """_id, _digest: of each id, one page (by the smallest hash of its text) that marks an article."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [weak_labels(parse_blocks(page)) is not None for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(marks, pa.bool_())) for c in batch.columns[:2]], names=["_id", "_digest"])

    # Without such a tag there is nothing to parse.
    likely = pages.where(F.col("_html").rlike("(?i)<(article|main)")).select("_id", F.xxhash64("_html").alias("_digest"), "_html")
    marked = likely.mapInArrow(run, schema(("_id", field_type(pages, "_id")), ("_digest", "long")))
    return marked.groupBy("_id").agg(F.min("_digest").alias("_digest"))


def train_html(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", sample: int = SAMPLE_PAGES) -> Labeller:
    """A labeller trained on at most ``sample`` of the pages that mark their article, picked by a hash of their id.

    Where no page does, the labeller is not taught, and ``extract_text`` goes by the rule of ``rule_odds``.
    """
    texts = pages.select(F.col(id_column).alias("_id"), F.col(html_column).cast("string").alias("_html")).where("_id IS NOT NULL AND _html IS NOT NULL")
    path = scratch_dir(pages.sparkSession, "teaching")
    teaching_pages(texts).write.parquet(path)
    marked = pages.sparkSession.read.parquet(path)
    chosen = first_by_hash(marked, "_id", sample, marked.count())
    # At most one page of each picked id.
    picked = texts.withColumn("_digest", F.xxhash64("_html")).join(F.broadcast(chosen), ["_id", "_digest"])
    rows = picked.groupBy("_id").agg(F.min("_html").alias("_html")).orderBy("_id").collect()
    model = train_labeller(training_pages([row["_html"] for row in rows]))
    model.taught = bool(rows)
    return model


def rule_odds(blocks: list[Block]) -> np.ndarray:
    """Without a taught labeller: all but the parts whose tags or class words tell that they are not the article."""
    return np.array([float(not aside_part(block.path)) for block in blocks])


def main_text(blocks: list[Block], probabilities: np.ndarray) -> str:
    kept = [b.text for b, p in zip(blocks, probabilities) if p >= 0.5 and not hidden(b.path)]
    return "\n\n".join(kept)


def extract_text(pages: DataFrame, model: Labeller, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars.

    Where no page taught the labeller, ``rule_odds`` decides. A page without article blocks, and one whose html is null or empty, has the empty text. Ids and urls may be null
    or repeat; other columns are not read.
    """
    rows = pages.select(F.col(id_column).alias("_id"), F.col(url_column).alias("_url"), F.col(html_column).cast("string").alias("_html"))
    shared = pages.sparkSession.sparkContext.broadcast(model)  # of fixed size
    kinds = [(id_column, field_type(rows, "_id")), (url_column, field_type(rows, "_url")), ("text", "string"), ("n_chars", "long")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [parse_blocks(page) for page in filled(batch.column(2)).to_pylist()]
            model = shared.value
            odds = model.probabilities([block_vectors(b) for b in parsed]) if model.taught else [rule_odds(b) for b in parsed]
            texts = [main_text(blocks, p) for blocks, p in zip(parsed, odds)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=names)

    names = [name for name, _ in kinds]
    return rows.mapInArrow(run, schema(*kinds))
