"""Notes, pages, transcripts and practice material over the document tables."""

from pyspark.sql import functions as F

from scholium.bindings.registry import query
from scholium.functions.text import sentences
from scholium.operators import notes as op
from scholium.operators import practice

SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def _trim(expression: str) -> str:
    return f"regexp_replace({expression}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


SENTENCES = rf"""
WITH pieces AS (
  SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?][{SPACE}]+|\n+'),
         lambda s: {_trim("s")}), lambda s: s <> '') AS sentences
  FROM documents
), sentence AS (
  SELECT doc_id, unnest(range(len(sentences)))::BIGINT AS pos, unnest(sentences) AS sentence FROM pieces
), uses AS (SELECT doc_id, pos, unnest(regexp_extract_all(lower(sentence), '\p{{L}}+')) AS term FROM sentence),
freq AS (
  SELECT term, ln((SELECT count(*) FROM documents)::DOUBLE / count(*)) AS idf
  FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS term FROM documents) GROUP BY term
)
"""

KEY_TERMS = SENTENCES + """
, scored AS (
  SELECT doc_id, term, pos, round(tf * idf, 6) AS score FROM (
    SELECT doc_id, term, count(*) AS tf, min(pos) AS pos FROM uses GROUP BY doc_id, term
  ) JOIN freq USING (term)
), key_terms AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(term) < 4, score DESC, term) AS card FROM scored
)
"""


def _blank(sentence: str, term: str) -> str:
    once = rf"regexp_replace({sentence}, '(?i)(^|[^\p{{L}}])' || {term} || '($|[^\p{{L}}])', '\1____\2', 'g')"
    return rf"regexp_replace({once}, '(?i)(^|[^\p{{L}}])' || {term} || '($|[^\p{{L}}])', '\1____\2', 'g')"


# The documents have no description of their own; their first sentence stands in for it.
LIST = SENTENCES + """
SELECT 'Note ' || doc_id::VARCHAR AS title, source AS subject, sentences[1] AS description,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * doc_id AS created
FROM documents JOIN pieces USING (doc_id)
"""


def _notes(t):
    return t("documents").select(
        F.concat(F.lit("Note "), F.col("doc_id").cast("string")).alias("title"),
        "source",
        F.get(sentences("text"), F.lit(0)).alias("description"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + doc_id * interval '1' minute").alias("created"),
    )


@query(LIST)
def list_notes(t):
    return op.list_notes(_notes(t), "title", "source", "description", "created")


@query(LIST + "WHERE source = 'src3'")
def notes_of_subject(t):
    return op.list_notes(_notes(t), "title", "source", "description", "created", only="src3")


@query("SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'license')")
def keyword_filter(t):
    return op.keyword_filter(t("documents"), "text", " LICENSE ").select("doc_id", "lang", "source")


def _sql_entities(expression: str) -> str:
    for entity, character in (
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")
    ):
        expression = f"replace({expression}, '{entity}', '{character}')"
    return expression


def _sql_squeeze(expression: str) -> str:
    return _trim(f"regexp_replace({expression}, '[{SPACE}]+', ' ', 'g')")


def _sql_without(expression: str) -> str:
    """Comments, then one element after the other; the query takes all of them in one pass."""
    expression = f"regexp_replace({expression}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style", "nav", "head", "footer"):
        expression = rf"regexp_replace({expression}, '(?is)<{tag}\b.*?</{tag}\s*>', ' ', 'g')"
    return expression


_VISIBLE = f"regexp_replace({_sql_without('html')}, '(?s)<[^>]*>', ' ', 'g')"
_TITLE = r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\s*>', 1)"


@query(f"""
SELECT page_id, url, {_sql_entities(_sql_squeeze(_TITLE))} AS title,
       {_sql_squeeze(_sql_entities(_VISIBLE))} AS text
FROM pages
""")
def clean_pages(t):
    return op.clean_pages(t.spread("pages", "page_id"), "html")


@query(SENTENCES + "SELECT doc_id, pos, sentence FROM sentence")
def extract_notes(t):
    return op.extract_notes(t.spread("documents", "doc_id"), "doc_id", "text")


@query(SENTENCES + """
, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rn
  FROM (SELECT doc_id, pos, round(avg(idf), 6) AS score FROM uses JOIN freq USING (term) GROUP BY doc_id, pos)
)
SELECT doc_id, any_value(source) AS title, string_agg(sentence, ' ' ORDER BY pos) AS summary, count(*) AS n_sentences
FROM ranked JOIN sentence USING (doc_id, pos) JOIN documents USING (doc_id) WHERE rn <= 2 GROUP BY doc_id
""")
def summarise(t):
    return op.summarise(t.spread("documents", "doc_id"), "doc_id", "source", "text", 2)


@query(KEY_TERMS + f"""
SELECT doc_id, source AS title, card, {_blank("sentence", "term")} AS question, term AS answer
FROM key_terms JOIN sentence USING (doc_id, pos) JOIN documents USING (doc_id) WHERE card <= 2
""")
def make_flashcards(t):
    return practice.make_flashcards(t.spread("documents", "doc_id"), "doc_id", "source", "text", 2)


QUIZ = f"""
, vocabulary AS (
  SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY df DESC, term) AS rank,
         count(*) OVER (PARTITION BY lang) AS size,
         ntile(3) OVER (PARTITION BY lang ORDER BY df DESC, term) AS third
  FROM (
    SELECT lang, term, count(*) AS df
    FROM (SELECT DISTINCT doc_id, lang, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS term FROM documents) GROUP BY lang, term
  )
), card AS (
  SELECT doc_id, source, lang, {_blank("sentence", "term")} AS question, term AS answer
  FROM key_terms JOIN sentence USING (doc_id, pos) JOIN documents USING (doc_id) WHERE card = 1
), placed AS (
  SELECT c.*, v.rank, v.size, v.third FROM card c JOIN vocabulary v ON v.lang = c.lang AND v.term = c.answer
), options AS (
  SELECT p.doc_id, list_sort(list(v.term) || [any_value(p.answer)]) AS options
  FROM placed p, range(1, 4) r(step), vocabulary v
  WHERE step < p.size AND v.lang = p.lang AND v.rank = (p.rank - 1 + step) % p.size + 1 GROUP BY p.doc_id
)
SELECT doc_id, source AS topic, CASE third WHEN 1 THEN 'Easy' WHEN 2 THEN 'Medium' ELSE 'Hard' END AS difficulty,
       question, array_to_string(options, ' | ') AS options, list_position(options, answer)::BIGINT AS right_option
FROM placed JOIN options USING (doc_id)
"""


@query(KEY_TERMS + QUIZ)
def make_quiz(t):
    return practice.make_quiz(t.spread("documents", "doc_id"), "doc_id", "source", "text", "lang")


# Key words are those of the chosen documents; difficulty is that of all words of the language.
CHOSEN = KEY_TERMS.replace("FROM documents", "FROM chosen").replace(
    "WITH pieces", "WITH chosen AS (SELECT * FROM documents WHERE source = 'src1'), pieces"
)


@query("SELECT * FROM (" + CHOSEN + QUIZ + ") WHERE difficulty = 'Easy' ORDER BY doc_id LIMIT 20")
def quiz_of_topic(t):
    docs = t.spread("documents", "doc_id")
    return practice.make_quiz(docs, "doc_id", "source", "text", "lang", topic="src1", difficulty="Easy", n=20)


@query(f"SELECT conv_id, turn, role, {_trim('text')} AS text FROM conversations WHERE length({_trim('text')}) > 0")
def clean_transcript(t):
    return op.clean_transcript(t("conversations"))


@query("""
WITH f AS (
  SELECT *, lead(turn) OVER w AS reply_turn, lead(role) OVER w AS next_role, lead(text) OVER w AS reply
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
)
SELECT conv_id, turn, text AS question, reply_turn, reply FROM f WHERE role = 'user' AND next_role = 'assistant'
""")
def pair_turns(t):
    return op.pair_turns(t("conversations"), "conv_id", "turn")


@query("""
WITH change AS (
  SELECT doc_id, 1 AS seq, 'replace' AS action, 'labels' AS source, 'low quality' AS text FROM labels WHERE quality = 0
  UNION ALL SELECT doc_id, 2, 'delete', NULL, NULL FROM labels WHERE toxic = 1
  UNION ALL SELECT 1000000000 + page_id, 1, 'create', url, html FROM pages
), latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS rn FROM change) WHERE rn = 1
)
SELECT doc_id, source, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM latest)
UNION ALL SELECT doc_id, source, text FROM latest WHERE action <> 'delete'
""")
def apply_note_changes(t):
    def change(table, key, seq, action, source, text):
        return table.select(
            key.alias("doc_id"),
            F.lit(seq).alias("seq"),
            F.lit(action).alias("action"),
            source.cast("string").alias("source"),
            text.cast("string").alias("text"),
        )

    labels, nothing = t("labels"), F.lit(None)
    changes = (
        change(labels.where("quality = 0"), F.col("doc_id"), 1, "replace", F.lit("labels"), F.lit("low quality"))
        .unionByName(change(labels.where("toxic = 1"), F.col("doc_id"), 2, "delete", nothing, nothing))
        .unionByName(change(t("pages"), F.lit(1000000000) + F.col("page_id"), 1, "create", F.col("url"), F.col("html")))
    )
    return op.apply_note_changes(t("documents").select("doc_id", "source", "text"), changes, "doc_id")
