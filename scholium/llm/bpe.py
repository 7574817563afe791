"""BPE encoding and decoding with a tokenization automaton.

The merges of a vocabulary file are compiled, one merge gadget after another, into a deterministic automaton over
tokens that accepts exactly the sequences BPE produces. It starts as one state that loops on every symbol. The
gadget of the merge (a, b) -> ab redirects the arcs of ``a`` to a copy of their target that has lost its arc of
``b``, and adds an arc of ``ab`` to the target of that lost arc. All arcs of a token always lead to one state, so a
copy is a pointer to the state it was made from and the arc it lost, and a vocabulary of any size compiles in one
pass. A word then has exactly one path that spells it, which is found by following arcs, longest tokens first. Decoding
emits the labels of the arcs.

The automaton is kept in this implicit form. Written out, a state and its arcs per token would be some 2.4 billion entries for
49,000 tokens. So the first use of a pair of tokens reads off the pointers and gadget numbers whether the arc is there
(``_arc``), and a table of transitions remembers the answer.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholium.llm.texts import field_type, filled, give_back, schema, slices, task_cache

# Unicode white space, which the vocabulary's pre-tokenizer drops.
WHITE = r"\t-\r \x85\xa0  -     　"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
# Letters and numbers of Unicode 16.0 that older tables of Python leave out, and its new capitals.
NEW_LETTERS = (
    "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e 11390-113b5 "
    "113b7 113d1 113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff 1e5d0-1e5ed 1e5f0"
)
NEW_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
NEW_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {
    c: c + 0x20 for c in range(0x10D50, 0x10D66)
}
# Python's split() takes these for white space, the vocabulary does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
# Symbols at the end of a word are shifted, so that one character stands for one symbol.
END = 0x1000
T_ARROW = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
# What a task keeps of words, chunks (bytes, ENTRY_BYTES of them for each entry besides its texts) and transitions
# (entries) before it starts again.
WORD_BYTES, CHUNK_BYTES, ENTRY_BYTES, TRANSITIONS = 1 << 26, 1 << 24, 190, 100_000
_NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    symbols, spare = [], 256
    for byte in range(256):
        if byte in plain:
            symbols.append(chr(byte))
        else:
            symbols.append(chr(spare))
            spare += 1
    return symbols


def word_pattern() -> str:
    """How texts are split: contractions, runs of letters, single numbers, runs of anything else but white space."""
    ranges: dict[str, list[str]] = {"L": [], "N": []}
    for kind, run in groupby(range(sys.maxunicode + 1), lambda c: unicodedata.category(chr(c))[0]):
        if kind in ranges:
            first, *rest = run
            last = rest[-1] if rest else first
            ranges[kind].append(f"\\U{first:08x}-\\U{last:08x}")
    for kind, added in (("L", NEW_LETTERS), ("N", NEW_NUMBERS)):
        for part in added.split():
            first, _, last = part.partition("-")
            ranges[kind].append(f"\\U{first:0>8}-\\U{last or first:0>8}")
    letters, numbers = "".join(ranges["L"]), "".join(ranges["N"])
    return rf"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{WHITE}{letters}{numbers}]+"


class TokenAutomaton:
    """The states and arcs of a merge list. Symbols are single characters.

    The state that the arcs of a token lead to is its last copy. It has lost what the gadgets of the token itself
    took, and what the copy it was made from, the state of the token's second part, had lost until then.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.spelling = {number: text for text, number in vocabulary.items()}
        # Of a merged token: rank of its gadget and its two parts.
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        # The gadget that took the arc of the second token from the state of the first.
        self.taken: dict[int, int] = {}
        self.ids = dict(vocabulary)
        idle: set[int] = set()
        for rank, (left, right) in enumerate(merges):
            first, second, merged = vocabulary[left], vocabulary[right], vocabulary[left + right]
            if first in idle or second in idle or not self._arc(first, second):
                # No path has this pair any more: the gadget changes nothing and its token is on no path.
                idle.add(merged)
                self.ids.pop(left + right, None)
                continue
            self.taken[first << 32 | second] = rank
            self.rank[merged] = rank
            self.parts[merged] = (first, second)
        self.transitions: dict[int, bool] = {}
        # Symbols of the longest token that begins with these (at most three) symbols.
        self.reach: dict[str, int] = {}
        for text in self.ids:
            self.reach[text[:3]] = max(self.reach.get(text[:3], 0), len(text))

    def _arc(self, before: int, token: int) -> bool:
        """Whether the state after ``before`` has an arc of ``token``: it was added and not lost again."""
        until = _NEVER
        while True:
            # ``until`` is when the arc of ``token`` had to be there for the arc of its merge to be added.
            state, copied = before, _NEVER
            while True:
                lost = self.taken.get(state << 32 | token, _NEVER)
                # A gadget of two equal parts takes the first part's arc as it adds its own: hence <=.
                if lost < copied and lost <= until:
                    return False
                if state not in self.parts:
                    break
                copied = self.rank[state]
                state = self.parts[state][1]
            if token not in self.parts:
                return True
            until = self.rank[token]
            token = self.parts[token][0]

    def has_arc(self, before: int, token: int) -> bool:
        """The transition table, filled as it is asked."""
        key = before << 32 | token
        known = self.transitions.get(key)
        if known is None:
            if len(self.transitions) >= TRANSITIONS:
                self.transitions.clear()
            known = self.transitions[key] = self._arc(before, token)
        return known

    def _match(self, word: str, start: int, most: int | None = None) -> int | None:
        """The longest token at ``start``, of at most ``most`` symbols."""
        reach = self.reach.get(word[start : start + 3], 2)
        for size in range(min(reach, len(word) - start) if most is None else min(most, reach), 0, -1):
            token = self.ids.get(word[start : start + size])
            if token is not None:
                return token
        return None

    def path(self, word: str) -> list[int]:
        """The tokens of the one accepted path that spells ``word``."""
        end, at = len(word), 0
        tokens: list[int] = []
        dead: set[int] = set()
        token = self._match(word, 0)
        while at < end:
            size = len(self.spelling[token])
            if at + size not in dead and (not tokens or self.has_arc(tokens[-1], token)):
                tokens.append(token)
                at += size
                if at < end:
                    token = self._match(word, at)
                continue
            shorter = self._match(word, at, size - 1)
            while shorter is None:
                # No arc leaves here on the spelling: step back over the last arc and shorten it.
                dead.add(at)
                last = tokens.pop()
                at -= len(self.spelling[last])
                shorter = self._match(word, at, len(self.spelling[last]) - 1)
            token = shorter
        return tokens


class Remembered(dict):
    """Texts and their ids, of at most so many bytes, a little more for the last; then it starts again."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held = most, 0

    def add(self, text: str, ids: bytes) -> None:
        if self.held >= self.most:
            self.clear()
            self.held = 0
        self[text] = ids
        self.held += ENTRY_BYTES + len(ids) + len(text)


class WordBpe:
    """A vocabulary file of the kind "BPE with word ends" as encoder and decoder of texts."""

    def __init__(self, definition: dict):
        model = definition["model"]
        suffix = model["end_of_word_suffix"]
        symbols = byte_symbols()

        def inner(text: str) -> str:
            return text[: -len(suffix) - 1] + chr(ord(text[-len(suffix) - 1]) + END) if text.endswith(suffix) else text

        merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.automaton = TokenAutomaton(
            {inner(text): number for text, number in model["vocab"].items()}, [(inner(a), inner(b)) for a, b in merges]
        )
        self.symbols = dict(enumerate(symbols))
        self.ends = [chr(ord(s) + END) for s in symbols]
        special = {token["content"]: token["id"] for token in definition["added_tokens"]}
        self.special = {text: np.uint32(number).tobytes() for text, number in special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.find_words = re.compile(word_pattern()).findall
        self.split_white = re.compile(rf"[{WHITE}]+").split
        labels = {number: text for text, number in model["vocab"].items()}
        labels.update({number: text for text, number in special.items()})
        self.labels = [labels.get(i, "") for i in range(max(labels, default=-1) + 1)]
        self.words = Remembered(WORD_BYTES)
        self.chunks = Remembered(CHUNK_BYTES)

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            raw = word.encode()
            spelled = raw[:-1].decode("latin-1").translate(self.symbols) + self.ends[raw[-1]]
            found = np.array(self.automaton.path(spelled), "<u4").tobytes()
            self.words.add(word, found)
        return found

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space; nothing in normalising or splitting reaches across white space."""
        pieces = [chunk] if self.split_special is None or "<|" not in chunk else self.split_special.split(chunk)
        out = []
        for piece in pieces:
            if piece in self.special:
                out.append(self.special[piece])
                continue
            if not piece.isascii():
                # Letters are lowered one by one: no final form of sigma.
                piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ").translate(NEW_CAPITALS)
            out.extend(map(self._word, self.find_words(piece.lower())))
        found = b"".join(out)
        self.chunks.add(chunk, found)
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, chunk = self.chunks.get, self._chunk
        out = []
        for piece in self.split_white(text) if SEPARATORS.search(text) else text.split():
            ids = known(piece)
            out.append(chunk(piece) if ids is None else ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, one blank between them, as a vocabulary without a decoder has it."""
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[str, WordBpe] = {}


def _vocabulary(definition: str) -> WordBpe:
    """Compiled once per Python worker."""
    task_cache("bpe", _loaded.clear)
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBpe(json.loads(definition))
    return _loaded[key]


def read_definition(path: str) -> str:
    """A vocabulary file as text; only the driver reads it."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode_texts(
    docs: DataFrame,
    definition: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    outputs: tuple[str, ...] = ("ids", "decoded"),
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens`` and the ``outputs`` asked for.

    Outputs are ``ids`` (binary, little-endian unsigned 32-bit), ``decoded`` (string), ``ids_sha256`` and
    ``decoded_sha256``. ``definition`` is the text of the vocabulary file; its size is bounded by its token count,
    and it is broadcast. Null and blank texts have no tokens and decode to the empty text. Repeated
    rows and null ids are kept; other columns are not read.
    """
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    kinds = {"ids": "binary", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    out_type = schema(
        (id_column, field_type(rows, "_id")), ("n_tokens", "long"), *[(name, kinds[name]) for name in outputs]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _vocabulary(shared.value)
        for batch in slices(batches, 1):
            columns: dict[str, list] = {name: [] for name in ("n_tokens", *outputs)}
            for text in filled(batch.column(1)):
                ids = bpe.encode(text.as_py())
                columns["n_tokens"].append(len(ids) // 4)
                decoded = bpe.decode(ids) if "decoded" in outputs or "decoded_sha256" in outputs else ""
                for name in outputs:
                    value = ids if name.startswith("ids") else decoded
                    if name.endswith("sha256"):
                        value = hashlib.sha256(value if isinstance(value, bytes) else value.encode()).hexdigest()
                    columns[name].append(value)
            arrays = [pa.array(columns[n], T_ARROW[k]) for n, k in [("n_tokens", "long"), *[(n, kinds[n]) for n in outputs]]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=out_type.names)

    return rows.mapInArrow(run, out_type)


def add_tokens(docs: DataFrame, definition: str, text_column: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` (array of int) and ``decoded_sha256`` behind its own columns.

    Columns of ``docs`` with these names are replaced.
    """
    base = docs.drop("n_tokens", "ids", "decoded_sha256")
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    at = base.columns.index(text_column)
    own = [(f"c{i}", f.dataType) for i, f in enumerate(base.schema.fields)]
    out_type = schema(*own, ("n_tokens", "long"), ("ids", T.ArrayType(T.IntegerType())), ("decoded_sha256", "string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _vocabulary(shared.value)
        for batch in slices(batches, at):
            raw = [bpe.encode(text) for text in filled(batch.column(at)).to_pylist()]
            ids = [np.frombuffer(r, "<u4").astype("int32") for r in raw]
            ends = np.cumsum([0, *map(len, ids)]).astype("int32")
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, "int32"), *ids])))
            digests = pa.array([hashlib.sha256(bpe.decode(r).encode()).hexdigest() for r in raw], pa.string())
            counts = pa.array(list(map(len, ids)), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, counts, lists, digests], names=out_type.names)
        give_back()

    encoded = base.mapInArrow(run, out_type)
    names = [F.col(f"c{i}").alias(name) for i, name in enumerate(base.columns)]
    return encoded.select(*names, "n_tokens", "ids", "decoded_sha256")


def decode_ids(encoded: DataFrame, definition: str, ids_column: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its token ids; null ids give the empty text, unknown ids no label."""
    shared = encoded.sparkSession.sparkContext.broadcast(definition)

    @F.pandas_udf("string")
    def labels(ids):
        known = _vocabulary(shared.value).labels
        return ids.map(lambda row: "" if row is None else " ".join(known[i] for i in row if 0 <= i < len(known)))

    return encoded.withColumn(into, labels(F.col(ids_column)))
