"""Fill-in-middle transformation of documents, as array operations on whole batches.

A text becomes a list of its code points. Flattened, each unit has the row it came from and its ordinal there; the
ordinal decides its role (prefix, middle or suffix). The units of a role are filtered, made into lists again and joined,
and the three parts are put together around sentinels in one of two orders. A text longer than a slice goes through
in several pieces, so the arrays of units stay small however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.texts import SLICE_BYTES, field_type, filled, schema, slices

# The sentinels, and of 100 texts how many are cut at all and how many of these have the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
SEED = "1:"
# Past the end of any text.
END = (1 << 31) - 1


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Buffer]:
    """Offsets of the texts, the bytes they point into, and these as a buffer."""
    _, offsets, data = texts.buffers()
    if data is None:
        data = pa.py_buffer(b"")
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    return ends, np.frombuffer(data, np.uint8), data


def _strings(offsets: np.ndarray, data: pa.Buffer) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), data)


def unit_lists(texts: pa.Array) -> pa.ListArray:
    """Each text as the list of its code points, which point into the bytes of the texts."""
    ends, raw, data = _characters(texts)
    starts = np.flatnonzero((raw[ends[0] : ends[-1]] & 0xC0) != 0x80) + ends[0]
    units = _strings(np.append(starts, ends[-1]), data)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, ends), pa.int32()), units)


def cut_pieces(texts: pa.Array, most: int) -> tuple[pa.Array, np.ndarray]:
    """Texts in pieces of at most ``most`` bytes and three more, and how many pieces lie before each text."""
    ends, raw, data = _characters(texts)
    offsets, first = [int(ends[0])], [0]
    for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
        at = start + most
        while at < end:
            if raw[at] & 0xC0 != 0x80:
                offsets.append(at)
                at += most
            else:
                at += 1
        offsets.append(end)
        first.append(len(offsets) - 1)
    return _strings(np.array(offsets), data), np.array(first)


def split_by_role(pieces: pa.Array, bases: np.ndarray, first_cut: np.ndarray, second_cut: np.ndarray) -> list[pa.Array]:
    """What of each piece is prefix, middle and suffix; ``bases`` is the ordinal of a piece's first unit in its text."""
    lists = unit_lists(pieces)
    units, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    starts = pc.subtract(lists.offsets[:-1].cast(pa.int64()), pa.array(bases, pa.int64()))
    ordinals = pc.subtract(pa.array(np.arange(len(units), dtype=np.int64)), pc.take(starts, parents))
    after_first = pc.greater_equal(ordinals, pc.take(pa.array(first_cut, pa.int64()), parents))
    after_second = pc.greater_equal(ordinals, pc.take(pa.array(second_cut, pa.int64()), parents))
    parts = []
    for role in (pc.invert(after_first), pc.and_not(after_first, after_second), after_second):
        owners = pc.filter(parents, role).to_numpy()
        offsets = np.searchsorted(owners, np.arange(len(pieces) + 1))
        rebuilt = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pc.filter(units, role))
        parts.append(pc.binary_join(rebuilt, ""))
    return parts


def split_texts(texts: pa.Array, first_cut: np.ndarray, second_cut: np.ndarray, most: int = SLICE_BYTES) -> list[pa.Array]:
    """Prefix, middle and suffix of each text, cut after so many code points."""
    pieces, first = cut_pieces(texts, most)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    lengths = pc.utf8_length(pieces).to_numpy().astype(np.int64)
    before = np.cumsum(lengths) - lengths
    bases = before - before[np.minimum(first[:-1], max(len(pieces) - 1, 0))][owner] if len(pieces) else before
    sizes = np.cumsum(pc.binary_length(pieces).to_numpy(), dtype=np.int64)
    done: list[list[pa.Array]] = [[], [], []]
    start = 0
    while start < len(pieces):
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + most, side="right")))
        rows = owner[start:end]
        for whole, part in zip(done, split_by_role(pieces.slice(start, end - start), bases[start:end], first_cut[rows], second_cut[rows])):
            whole.append(part)
        start = end
    offsets = pa.array(first, pa.int32())
    return [pc.binary_join(pa.ListArray.from_arrays(offsets, pa.concat_arrays(p or [pa.array([], pa.string())])), "") for p in done]


def _joined(*parts: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*parts, "")


def _draws(ids: list[str | None], seed: str) -> np.ndarray:
    """Four unsigned 32-bit numbers of each id; a null id counts as empty."""
    raw = b"".join(hashlib.sha256(f"{seed}{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


def rearranged(texts: pa.Array, ids: list[str | None], seed: str = SEED, most: int = SLICE_BYTES) -> dict[str, pa.Array]:
    """Columns n, form, prefix_chars, middle_chars and output of a batch of texts."""
    n = pc.utf8_length(texts).to_numpy().astype(np.int64)
    draw = _draws(ids, seed)
    one, two = draw[:, 0] % (n + 1), draw[:, 1] % (n + 1)
    first, second = np.minimum(one, two), np.maximum(one, two)
    plain = (n == 0) | (draw[:, 2] % 100 >= CUT_PERCENT)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        plain |= pc.match_substring(texts, sentinel).to_numpy(zero_copy_only=False)
    suffix_first = draw[:, 3] % 100 < SUFFIX_FIRST_PERCENT
    prefix, middle, suffix = split_texts(texts, first, second, most)
    cut = pc.if_else(
        pa.array(suffix_first),
        _joined(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle),
        _joined(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle),
    )
    return {
        "n": pa.array(n),
        "form": pa.array(np.where(plain, "plain", np.where(suffix_first, "spm", "psm")).tolist(), pa.string()),
        "prefix_chars": pa.array(first, mask=plain),
        "middle_chars": pa.array(second - first, mask=plain),
        "output": pc.if_else(pa.array(plain), texts, cut),
    }


def restored(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts again, from outputs and forms alone: cut at the first of each sentinel, put in the order of the text."""
    places, texts = [], []
    for form, lead, between in (("psm", PREFIX, SUFFIX), ("spm", SUFFIX, PREFIX), ("plain", None, None)):
        mask = pc.equal(forms, form)
        rows = pc.filter(outputs, mask)
        places.append(pc.indices_nonzero(mask))
        if lead is None:
            texts.append(rows)
            continue
        halves = pc.split_pattern(rows, MIDDLE, max_splits=1)
        sides = pc.split_pattern(pc.list_element(halves, 0), between, max_splits=1)
        ahead = pc.binary_slice(pc.list_element(sides, 0).cast(pa.binary()), len(lead), END).cast(pa.string())
        behind = pc.list_element(sides, 1)
        prefix, suffix = (ahead, behind) if form == "psm" else (behind, ahead)
        texts.append(_joined(prefix, pc.list_element(halves, 1), suffix))
    return pc.take(pa.concat_arrays(texts), pc.sort_indices(pa.concat_arrays(places)))


def fill_in_middle(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: id, ``n`` (code points), ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    The cuts and the form are drawn from a hash of ``seed`` and the id, so they do not depend on how rows are dealt out and
    rows that repeat an id and a text are transformed alike. ``form`` is ``psm`` or ``spm`` (suffix first), or ``plain``: the
    output is the text itself, and the counts are null. Null texts count as empty; empty texts and those that contain a
    sentinel are plain. A null id is drawn as an empty one. A very long text is cut whole, piece by piece. An empty table
    gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"), F.col(id_column).cast("string").alias("_name"))
    out = schema(
        (id_column, field_type(rows, "_id")), ("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            columns = rearranged(filled(batch.column(1)), batch.column(2).to_pylist(), seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns.values()], names=out.names)

    return rows.mapInArrow(run, out)


def restore_texts(transformed: DataFrame, output_column: str = "output", form_column: str = "form", into: str = "restored") -> DataFrame:
    """``transformed`` with the exact text rebuilt from its output and form; other columns stay, one named ``into`` is replaced.

    A null output gives the empty text, a null form counts as plain. An output that does not have the sentinels of its form
    is an error.
    """
    base = transformed.drop(into)
    own = [(f"c{i}", f.dataType) for i, f in enumerate(base.schema.fields)]
    out = schema(*own, ("_restored", "string"))
    text, form = base.columns.index(output_column), base.columns.index(form_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            again = restored(filled(batch.column(text)), pc.fill_null(batch.column(form), "plain"))
            yield pa.RecordBatch.from_arrays([*batch.columns, again], names=out.names)

    names = [F.col(f"c{i}").alias(name) for i, name in enumerate(base.columns)]
    return base.mapInArrow(run, out).select(*names, F.col("_restored").alias(into))


def fill_in_middle_sql(table: str) -> str:
    """DuckDB SQL for the digests of ``fill_in_middle`` and ``restore_texts``."""
    numbers = ", ".join(f"('0x' || h[{8 * k + 1}:{8 * k + 8}])::BIGINT AS h{k + 1}" for k in range(4))
    marked = " OR ".join(f"contains(s, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    return f"""
    WITH texts AS (
        SELECT doc_id, coalesce(text, '') AS s, length(coalesce(text, '')) AS n,
            sha256('{SEED}' || coalesce(doc_id::VARCHAR, '')) AS h
        FROM {table}
    ), drawn AS (
        SELECT doc_id, s, n, {numbers} FROM texts
    ), cuts AS (
        SELECT doc_id, s, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
            CASE WHEN n = 0 OR {marked} OR h3 % 100 >= {CUT_PERCENT} THEN 'plain'
                WHEN h4 % 100 < {SUFFIX_FIRST_PERCENT} THEN 'spm' ELSE 'psm' END AS form
        FROM drawn
    ), parts AS (
        SELECT *, substring(s, 1, a) AS prefix, substring(s, a + 1, b - a) AS middle, substring(s, b + 1, n - b) AS suffix FROM cuts
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN s
            WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
            ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
        sha256(s) AS restored_sha256
    FROM parts
    """
