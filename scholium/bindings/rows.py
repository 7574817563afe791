"""Column functions and row operators over whole tables."""

from pyspark.sql import functions as F

from scholium.bindings.canonical import activity
from scholium.bindings.registry import query
from scholium.functions import columns as c
from scholium.operators import rows

TRIM = r"regexp_replace({0}, '^[\t\n\x0B\f\r \x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]+|[\t\n\x0B\f\r \x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]+$', '', 'g')"


@query("""
SELECT p_partkey,
       upper(substr(split_part(p_name, ' ', 1), 1, 1)) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) AS initials
FROM part
""")
def initials(t):
    return t("part").select("p_partkey", c.initials("p_name").alias("initials"))


@query("""
SELECT c_custkey, least(100.0::DOUBLE, greatest(0.0::DOUBLE, c_acctbal / 50)) AS pct FROM customer
""")
def clamp_pct(t):
    return t("customer").select("c_custkey", c.clamp_pct(F.col("c_acctbal") / 50).alias("pct"))


@query("""
SELECT p_partkey, CASE WHEN p_size - 5 > 9 THEN '9+' WHEN p_size - 5 > 0 THEN (p_size - 5)::VARCHAR END AS badge
FROM part
""")
def capped_count(t):
    return t("part").select("p_partkey", c.capped_count(F.col("p_size") - 5).alias("badge"))


@query(f"""
WITH lines AS (
  SELECT doc_id, {TRIM.format("unnest(string_split(text, chr(10)))")} AS line FROM documents
)
SELECT doc_id, line FROM lines WHERE length(line) > 0
""")
def drop_blank(t):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return rows.drop_blank(lines, "line")


@query("""
WITH last AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id)
SELECT conv_id, turn, role, text FROM conversations
UNION ALL
SELECT b.item_id, coalesce(l.turn, -1) + 1, 'user', b.text
FROM benchmark b LEFT JOIN last l ON l.conv_id = b.item_id
""")
def append(t):
    sent = t("benchmark").select(
        F.col("item_id").alias("conv_id"),
        F.lit(1).cast("bigint").alias("turn"),
        F.lit("user").alias("role"),
        "text",
    )
    return rows.append(t("conversations"), sent, "conv_id", "turn")


@query("SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC")
def newest_first(t):
    return rows.newest_first(t("events").select("event_id", "ts", "user_id", "event_type"), "ts", "event_id")


@query("""
WITH writes AS (
  SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'segment' ELSE 'goal' END AS field,
         nullif(o_orderpriority, '1-URGENT') AS value, o_orderdate, o_orderkey
  FROM orders
), latest AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, field ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM writes
)
SELECT c.c_custkey, c.c_name AS name,
       CASE WHEN s.o_custkey IS NOT NULL THEN s.value ELSE c.c_mktsegment END AS segment,
       CASE WHEN g.o_custkey IS NOT NULL THEN g.value ELSE 'none' END AS goal
FROM customer c
LEFT JOIN latest s ON s.o_custkey = c.c_custkey AND s.field = 'segment' AND s.rn = 1
LEFT JOIN latest g ON g.o_custkey = c.c_custkey AND g.field = 'goal' AND g.rn = 1
""")
def apply_patches(t):
    base = t("customer").select(
        "c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.lit("none").alias("goal")
    )
    writes = t("orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.when(F.col("o_orderstatus") == "F", "segment").otherwise("goal").alias("field"),
        F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("value"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("seq"),
    )
    return rows.apply_patches(base, writes, "c_custkey", ["segment", "goal"])


@query("""
SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'user' ELSE role END AS speaker FROM conversations
""")
def default_if_blank(t):
    return t("conversations").select(
        "conv_id", "turn", c.default_if_blank(F.replace("role", F.lit("system"), F.lit("")), "user").alias("speaker")
    )


@query("""
SELECT l_orderkey AS quiz_id,
       count(*) FILTER (l_returnflag = 'A')::VARCHAR || '/' || count(*)::VARCHAR AS score,
       '#' || max(l_linenumber)::VARCHAR AS last_question
FROM lineitem GROUP BY l_orderkey
""")
def score_label(t):
    scores = t("lineitem").groupBy(F.col("l_orderkey").alias("quiz_id")).agg(
        F.count_if(F.col("l_returnflag") == "A").alias("correct"),
        F.count("*").alias("total"),
        F.max("l_linenumber").alias("last"),
    )
    return scores.select(
        "quiz_id", c.score_label("correct", "total").alias("score"), c.rank_label("last").alias("last_question")
    )


@query("""
SELECT event_id, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'danger' WHEN 'signup' THEN 'info'
       ELSE 'default' END AS tone
FROM events
""")
def lookup(t):
    tones = {"purchase": "success", "error": "danger", "signup": "info"}
    return t("events").select("event_id", c.lookup("event_type", tones, "default").alias("tone"))


@query("""
SELECT doc_id, lang, source FROM documents WHERE lang = 'es'
UNION ALL
SELECT doc_id, lang, source FROM documents WHERE lang = 'it'
UNION ALL
SELECT -1, 'it', 'No notes yet' WHERE NOT EXISTS (SELECT 1 FROM documents WHERE lang = 'it')
""")
def or_default_row(t):
    notes = t("documents").select("doc_id", "lang", "source")
    nothing = {"doc_id": -1, "source": "No notes yet"}
    spanish = rows.or_default_row(notes.where("lang = 'es'"), {**nothing, "lang": "es"})
    return spanish.unionByName(rows.or_default_row(notes.where("lang = 'it'"), {**nothing, "lang": "it"}))


@query("SELECT conv_id, turn, role IS NOT DISTINCT FROM 'user' AS is_user FROM conversations")
def flag(t):
    return t("conversations").select("conv_id", "turn", c.flag("role", "user").alias("is_user"))


@query("""
SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS position,
       row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS position_in_kind
FROM events
""")
def with_position(t):
    order = [F.col("minutes").desc(), F.col("event_id")]
    events = activity(t).select("event_id", "kind", "minutes")
    overall = rows.with_position(events, order)
    return rows.with_position(overall, order, ["kind"], "position_in_kind").select(
        "event_id", "position", "position_in_kind"
    )


@query("SELECT p_partkey, unnest(range(p_size))::BIGINT AS i FROM part")
def expand_n(t):
    return rows.expand_n(t("part").select("p_partkey", "p_size"), "p_size").select("p_partkey", "i")


@query("""
SELECT conv_id, turn, coalesce(nullif(role, 'system') <> '' AND text <> '', false) AS complete FROM conversations
""")
def present(t):
    return t("conversations").select(
        "conv_id", "turn", c.present(F.nullif("role", F.lit("system")), "text").alias("complete")
    )


@query(r"""
SELECT page_id,
       coalesce(nullif(list_filter(string_split_regex(url, '[/?#=&]'), lambda x: regexp_full_match(x, '[0-9]+'))[1], ''),
                'none') AS first_number
FROM pages
""")
def first_or(t):
    numbers = F.filter(F.split("url", "[/?#=&]"), lambda part: part.rlike("^[0-9]+$"))
    return t("pages").select("page_id", c.first_or(numbers, "none").alias("first_number"))


@query("SELECT doc_id, lang, source, CAST(NULL AS VARCHAR) AS title, n_chars FROM documents")
def fields(t):
    return rows.fields(t("documents"), "doc_id", "lang", "source", "title", "n_chars")


@query("""
SELECT p_partkey, CASE WHEN p_size < 10 THEN 'short' WHEN p_size < 30 THEN 'medium' ELSE 'long' END AS length
FROM part
""")
def case_label(t):
    size = F.col("p_size")
    return t("part").select("p_partkey", c.case_label([(size < 10, "short"), (size < 30, "medium")], "long").alias("length"))
