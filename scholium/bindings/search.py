"""Keyword and vector search."""

from pyspark.sql import functions as F

from scholium.bindings.registry import query
from scholium.operators import search as op

DIMENSIONS = 64


RANKED = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS words FROM documents),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(words)) AS mean FROM w),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM benchmark),
postings AS (
  SELECT doc_id, length, term, count(*)::DOUBLE AS tf
  FROM (SELECT doc_id, len(words) AS length, unnest(words) AS term FROM w)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), freq AS (SELECT term, count(*)::DOUBLE AS df FROM postings GROUP BY term),
hits AS (
  SELECT item_id, doc_id,
         round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
           / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score
  FROM asked JOIN freq USING (term) JOIN postings USING (term), stats GROUP BY item_id, doc_id
)
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS position FROM hits
) WHERE position <= 10
"""


@query(RANKED)
def ranked_search(t):
    return op.ranked_search(t.spread("documents"), t("benchmark"), "doc_id", "text", "item_id", "text", 10)


@query(RANKED)
def ranked_search_in_slabs(t):
    """The way taken for more queries than are broadcast."""
    docs, asked = t.spread("documents"), t("benchmark")
    return op.ranked_search(docs, asked, "doc_id", "text", "item_id", "text", 10, broadcast_entries=0)


CENTRES = """
WITH centre AS (
  SELECT label::BIGINT AS query_id, list(mean ORDER BY i) AS embedding FROM (
    SELECT label, i, avg(embedding[i]::DOUBLE) AS mean FROM embeddings, range(1, 65) r(i) GROUP BY label, i
  ) GROUP BY label
), hits AS (
  SELECT query_id, vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], c.embedding), 6) AS score
  FROM embeddings e, centre c
), best AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS position FROM hits
  ) WHERE position <= 10
)
"""


def _centres(t):
    """One query per label: the mean of its vectors."""
    mean = F.array(*[F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(DIMENSIONS)])
    return t("embeddings").groupBy(F.col("label").cast("bigint").alias("query_id")).agg(mean.alias("embedding"))


@query(CENTRES + "SELECT * FROM best")
def semantic_search(t):
    return op.semantic_search(t("embeddings").select("vec_id", "embedding"), _centres(t), 10)


@query(CENTRES + "SELECT * FROM best")
def semantic_search_in_slabs(t):
    """The way taken for more queries than are broadcast."""
    return op.semantic_search(t("embeddings").select("vec_id", "embedding"), _centres(t), 10, broadcast_queries=0)


@query(CENTRES + """
, used AS (
  SELECT query_id, position, text,
         sum(length(text) + 2) OVER (PARTITION BY query_id ORDER BY position) - 2 AS used
  FROM best JOIN documents ON doc_id = vec_id
)
, packed AS (
  SELECT query_id, count(*) AS n_chunks, max(used)::BIGINT AS chars,
         string_agg(text, chr(10) || chr(10) ORDER BY position) AS context
  FROM used WHERE used <= 4000 GROUP BY query_id
)
SELECT query_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(chars, 0) AS chars, coalesce(context, '') AS context
FROM centre LEFT JOIN packed USING (query_id)
""")
def retrieve_context(t):
    return op.retrieve_context(t("embeddings").select("vec_id", "embedding"), t("documents"), _centres(t), 10, 4000)
