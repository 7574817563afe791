"""Ranked keyword search, vector search, and packing of hits into a context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from scholium.functions.kernels import BestPerQuery, id_array, unit_rows
from scholium.functions.text import words
from scholium.operators.inverted import K1, B, build_index, search_index
from scholium.operators.pivots import MATRIX_CELLS, build_pivots, search_pivots
from scholium.operators.terms import SCORE_DIGITS
from scholium.plans import collect_bounded, cut_lineage, top_per_key

# Most queries sent to every task.
BROADCAST_QUERIES = 2048
BROADCAST_ENTRIES = 200_000
BROADCAST_HITS = 200_000
# Between the texts of a context.
SEPARATOR = "\n\n"
# Most widths of query vectors.
WIDTHS = 16


def _postings(docs: DataFrame, terms: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(document, length, word, count) for the words in ``terms``.

    Each document also has one row for the empty word, which carries its length. The corpus
    is thus read and split into words once: document frequencies, sizes and scores all come
    from the same shuffled counts.
    """
    split = docs.select(doc_id, words(text).alias("_words"))
    uses = split.select(
        doc_id, F.size("_words").alias("length"), F.explode(F.array_append("_words", F.lit(""))).alias("term")
    )
    # The last test always holds; it keeps the count in every use, so that all share one shuffle.
    return (
        uses.join(terms, "term", "left_semi")
        .groupBy(doc_id, "length", "term")
        .agg(F.count("*").alias("tf"))
        .where(F.col("tf") > 0)
    )


def _impacts(postings: DataFrame) -> tuple[DataFrame, Column]:
    """Idf per word, and the weight of a posting given its ``idf``."""
    by_term = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("length").alias("_length"))
    sizes = by_term.agg(F.max(F.when(F.col("term") == "", F.struct("df", "_length"))).alias("s")).select("s.*")
    n = sizes.select(F.col("df").cast("double")).scalar()
    mean_length = sizes.select(F.col("_length") / F.col("df")).scalar()
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf").cast("double")
    impact = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / mean_length))
    return by_term.select("term", idf.alias("idf")), impact


def ranked_search(
    docs: DataFrame,
    queries: DataFrame,
    doc_id: str,
    text: str,
    query_id: str,
    query_text: str,
    k: int,
    broadcast_entries: int = BROADCAST_ENTRIES,
) -> DataFrame:
    """BM25 top ``k`` documents for every query; equal scores go to the lower document.

    Tasks score their documents against all queries and pass on the best ``k`` of each, so no pair of query and
    document is ever a row. Up to ``broadcast_entries`` (query, word) pairs go to every task; for more, the texts are indexed
    once and slabs of queries go over the index (``scholium.operators.inverted``).
    """
    asked = queries.select(query_id, F.explode(F.array_distinct(words(query_text))).alias("term"))
    entries = collect_bounded(asked, broadcast_entries)
    order = [F.col("score").desc(), F.col(doc_id)]
    schema = _hit_schema(queries, query_id, docs, doc_id)
    if entries is None:
        asked = cut_lineage(asked)
        found = search_index(build_index(docs, doc_id, text), asked, query_id, k, schema)
        return top_per_key(found, [query_id], order, k)
    names = sorted({row[0] for row in entries})
    terms = sorted({row[1] for row in entries})
    empty = queries.sparkSession.range(1).select(F.lit("").alias("term"))
    numbered = queries.sparkSession.createDataFrame(list(enumerate(terms)), "no int, term string")
    postings = _postings(docs, F.broadcast(numbered.select("term").unionByName(empty)), doc_id, text)
    idf, impact = _impacts(postings)
    known = F.broadcast(idf.join(F.broadcast(numbered), "term"))
    scored = postings.join(known, "term").select(doc_id, "no", impact.alias("impact"))
    of_doc = scored.groupBy(doc_id).agg(F.collect_list("no").alias("no"), F.collect_list("impact").alias("impact"))
    number_of_term = {term: i for i, term in enumerate(terms)}
    number_of_query = {name: i for i, name in enumerate(names)}
    pairs = sorted((number_of_query[q], number_of_term[t]) for q, t in entries)
    partial = _score_documents(of_doc, names, pairs, len(terms), k, schema)
    return top_per_key(partial, [query_id], order, k)


def _query_sums(weights: np.ndarray, entries: np.ndarray, n_queries: int) -> np.ndarray:
    """(rows, queries) sums of the weights of each query's words; not-a-number where none occurs."""
    asking, starts = np.unique(entries[:, 0], return_index=True)
    sums = np.add.reduceat(weights[:, entries[:, 1]], starts, axis=1)
    scores = np.full((len(weights), n_queries), np.nan)
    scores[:, asking] = np.where(sums > 0, sums, np.nan)
    return scores


def _hit_schema(queries: DataFrame, query_id: str, items: DataFrame, item_id: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField(query_id, queries.schema[query_id].dataType),
            T.StructField(item_id, items.schema[item_id].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _best_rows(best: BestPerQuery, names: list, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    if best.ids is not None and len(best.ids):
        kinds = [to_arrow_type(field.dataType) for field in schema.fields]
        values = [[names[q] for q in best.queries], best.ids.tolist(), best.scores.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names=schema.names)


def _score_documents(
    of_doc: DataFrame, names: list, pairs: list[tuple[int, int]], n_terms: int, k: int, schema: T.StructType
) -> DataFrame:
    """Best documents per query in each task; a row holds the numbers and weights of a document's words."""
    shared = of_doc.sparkSession.sparkContext.broadcast((names, np.array(pairs, dtype=np.int64).reshape(-1, 2)))

    def best_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_names, entries = shared.value
        rows_at_once = max(1, MATRIX_CELLS // max(1, n_terms + len(entries)))
        best = BestPerQuery(k, SCORE_DIGITS)
        for whole in batches:
            for first in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(first, rows_at_once)
                term_lists = batch.column(1)
                row = np.repeat(np.arange(batch.num_rows), term_lists.value_lengths().to_numpy())
                weights = np.zeros((batch.num_rows, n_terms))
                weights[row, term_lists.flatten().to_numpy()] = batch.column(2).flatten().to_numpy()
                best.offer(_query_sums(weights, entries, len(query_names)), id_array(batch.column(0)))
        yield from _best_rows(best, query_names, schema)

    return of_doc.mapInArrow(best_of_task, schema)


def _chunk_matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def _cosine_from_broadcast(chunks: DataFrame, names: list, matrix, k: int, width: int, schema: T.StructType):
    shared = chunks.sparkSession.sparkContext.broadcast((names, unit_rows(matrix)))

    def best_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_names, unit_queries = shared.value
        rows_at_once = max(1, MATRIX_CELLS // (len(query_names) + width))
        best = BestPerQuery(k, SCORE_DIGITS)
        for whole in batches:
            for first in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(first, rows_at_once)
                vectors = unit_rows(_chunk_matrix(batch.column(1), width))
                best.offer(vectors @ unit_queries.T, id_array(batch.column(0)))
        yield from _best_rows(best, query_names, schema)

    return chunks.mapInArrow(best_of_task, schema)


def _hits(
    chunks: DataFrame, queries: DataFrame, k: int, chunk_id: str, query_id: str, vector: str, most: int
) -> tuple[DataFrame, bool]:
    """Best chunks per query, and whether their number is known to be small."""
    asked = queries.where(F.col(vector).isNotNull()).select(query_id, vector)
    rows = collect_bounded(asked, most)
    schema = _hit_schema(queries, query_id, chunks, chunk_id)
    if rows is None:
        found = collect_bounded(asked.select(F.size(vector).alias("width")).distinct(), WIDTHS)
        if found is None:
            raise ValueError(f"query vectors of more than {WIDTHS} widths")
        widths = sorted(row["width"] for row in found)
    else:
        widths = sorted({len(row[1]) for row in rows})
    partial = queries.sparkSession.createDataFrame([], schema)
    # Only vectors of one width can be compared, and no element may be missing.
    for width in widths:
        comparable = chunks.where((F.size(vector) == width) & ~F.exists(vector, lambda x: x.isNull())).select(chunk_id, vector)
        if rows is None:
            index = build_pivots(comparable, chunk_id, vector, width)
            hits = search_pivots(index, asked.where(F.size(vector) == width), query_id, vector, k, schema)
        else:
            same = [row for row in rows if len(row[1]) == width]
            matrix = np.array([row[1] for row in same], dtype=np.float64)
            hits = _cosine_from_broadcast(comparable, [row[0] for row in same], matrix, k, width, schema)
        partial = hits if width == widths[0] else partial.unionByName(hits)
    hits = top_per_key(partial, [query_id], [F.col("score").desc(), F.col(chunk_id)], k)
    return hits, rows is not None and len(rows) * k <= BROADCAST_HITS


def semantic_search(
    chunks: DataFrame,
    queries: DataFrame,
    k: int,
    chunk_id: str = "vec_id",
    query_id: str = "query_id",
    vector: str = "embedding",
    broadcast_queries: int = BROADCAST_QUERIES,
) -> DataFrame:
    """Exact cosine top ``k`` chunks per query.

    Each task multiplies its chunks with the query vectors and passes on its best ``k`` per
    query, so no pair of query and chunk is ever a row. Up to ``broadcast_queries`` queries
    go to every task and the chunks stay where they are; for more, the chunks are written once beside their nearest
    pivots, and slabs of queries go over those they may need (``scholium.operators.pivots``).
    """
    return _hits(chunks, queries, k, chunk_id, query_id, vector, broadcast_queries)[0]


def retrieve_context(
    chunks: DataFrame,
    docs: DataFrame,
    queries: DataFrame,
    k: int,
    budget: int,
    chunk_id: str = "vec_id",
    doc_id: str = "doc_id",
    text: str = "text",
    query_id: str = "query_id",
    vector: str = "embedding",
) -> DataFrame:
    """Texts of the best hits per query in rank order, as many as fit in ``budget`` characters, separators included.

    Every query has a row: where not even the first text fits, or nothing was found, its context is empty.
    """
    hits, few = _hits(chunks, queries, k, chunk_id, query_id, vector, BROADCAST_QUERIES)
    found = hits.withColumnRenamed(chunk_id, doc_id)
    texts = docs.select(doc_id, text).join(F.broadcast(found) if few else found, doc_id)
    so_far = Window.partitionBy(query_id).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.length(text) + len(SEPARATOR)).over(so_far) - len(SEPARATOR)
    packed = texts.withColumn("_used", used).where(F.col("_used") <= budget)
    ordered = F.sort_array(F.collect_list(F.struct("position", text)))
    contexts = packed.groupBy(query_id).agg(
        F.count("*").alias("n_chunks"),
        F.max("_used").alias("chars"),
        F.array_join(F.transform(ordered, lambda hit: hit[text]), SEPARATOR).alias("context"),
    )
    every = queries.select(query_id).distinct()
    return every.join(contexts, query_id, "left").select(
        query_id,
        F.coalesce("n_chunks", F.lit(0).cast("bigint")).alias("n_chunks"),
        F.coalesce("chars", F.lit(0).cast("bigint")).alias("chars"),
        F.coalesce("context", F.lit("")).alias("context"),
    )
