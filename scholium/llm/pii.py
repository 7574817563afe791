"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans. Checksums (Luhn for cards, mod 97 for account numbers) and value ranges confirm
them. Weaker proposals, which a pattern alone does not settle, start with a low score that words nearby raise; they
count from ``MIN_SCORE`` on. Spans are given in code points, the end exclusive.

A pattern is run twice over a text in which it occurs: once for the matches, once for what lies between them. The
lengths of both give the offsets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns. Possessive repeats and the look-behinds only spare the engine dead
# starts: inside a run of the first class a match begins at the run's first place or where the last match ended.
LOCAL = "A-Za-z0-9._%+-"
HOST = "[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
EMAIL = f"(?:(?<![{LOCAL}])|\\G)[{LOCAL}]++@{HOST}"
IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "[0-9](?:[ -]?[0-9])++"
PHONE = "\\+[0-9][ ().0-9-]+[0-9]"
# Added by the method: account numbers in groups or as one run, and phone numbers without a country code.
IBAN = "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
LOCAL_PHONE = "(?<![0-9+.(-])(?<!\\) )(?<![0-9] )\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])"
KINDS = ["email", "ip", "card", "phone", "iban", "local_phone"]

OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP_VALUE = f"^{OCTET}(?:\\.{OCTET}){{3}}$"
# Words that speak for a number to be called, in the languages of the corpus.
PHONE_WORDS = "(?i)(?<![A-Za-z])(?:phone|telephone|tel|mobile|cell|call|fax|whatsapp|telefon|handy|anruf|téléphone|appel|appelez|teléfono|móvil|llama)(?![A-Za-z])"
CONTEXT = 40  # code points before and after a proposal
MIN_SCORE = 0.5


def _proposals(text: Column, pattern: str) -> tuple[Column, Callable[[Column], Column]]:
    """The leftmost non-overlapping matches, and what turns them into an array of (start, end, value)."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("found"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(state["found"], span).alias("found"))

    def offsets(found: Column) -> Column:
        pairs = F.transform(found, lambda value, i: F.struct(F.get(between, i).alias("gap"), value.alias("value")))
        return F.aggregate(pairs, empty, step, lambda state: state["found"])

    return matches, offsets


def luhn_ok(digits: Column) -> Column:
    """Whether the last digit is the Luhn check digit of the others."""
    places = F.split(F.reverse(digits), "")
    worth = F.transform(
        F.filter(places, lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) - F.when(d >= "5", 9).otherwise(0)),
    )
    return F.aggregate(worth, F.lit(0), lambda total, d: total + d) % 10 == 0


def mod97_ok(account: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters as 10..35, is 1 modulo 97."""
    turned = F.concat(F.substring(account, 5, 60), F.substring(account, 1, 4))
    places = F.filter(F.split(turned, ""), lambda c: c != "")

    def step(rest: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.when(digit, rest * 10 + c.cast("int")).otherwise(rest * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(places, F.lit(0), step) == 1


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``spans`` (array of kind, start, end, score, value, by start and kind).

    Base kinds (email, ip, card, phone) are reported whenever pattern and validator agree, with a score of 1 where a
    checksum confirms and less where only the form does; words nearby raise it. Account numbers need mod 97, phone
    numbers without a country code need a word nearby. Null and empty texts have no spans; null ids and repeated
    rows stay; other columns are not read.
    """
    text = F.col("_text")
    rows = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("_text"))
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "local_phone": LOCAL_PHONE}
    # What a text must contain at least; all but a few texts skip most patterns.
    needs = {
        "email": F.contains(text, F.lit("@")),
        "ip": F.col("_digits"),
        "card": F.col("_digits"),
        "phone": F.col("_digits") & F.contains(text, F.lit("+")),
        "iban": F.col("_digits"),
        "local_phone": F.col("_digits"),
    }
    rows = rows.withColumn("_digits", text.rlike("[0-9]"))
    makers = {}
    for kind, pattern in patterns.items():
        matches, makers[kind] = _proposals(text, pattern)
        rows = rows.withColumn(f"_{kind}", F.when(needs[kind], matches).otherwise(F.array().cast("array<string>")))
    for kind in patterns:
        none = F.array().cast("array<struct<start:int,end:int,value:string>>")
        rows = rows.withColumn(f"_{kind}", F.when(F.size(f"_{kind}") > 0, makers[kind](F.col(f"_{kind}"))).otherwise(none))

    def digits(value: Column) -> Column:
        return F.regexp_replace(value, "[^0-9]", "")

    def near(span: Column) -> Column:
        before = F.greatest(span["start"] - CONTEXT, F.lit(0))
        return F.substring(text, before + 1, span["end"] - before + CONTEXT).rlike(PHONE_WORDS)

    confirmed = {
        "email": lambda s: F.lit(0.9),
        "ip": lambda s: F.when(s["value"].rlike(IP_VALUE), 0.7),
        "card": lambda s: F.when(F.length(digits(s["value"])).between(14, 19) & luhn_ok(digits(s["value"])), 1.0),
        "phone": lambda s: F.when(F.length(digits(s["value"])).between(10, 15), F.when(near(s), 0.9).otherwise(0.7)),
        "iban": lambda s: F.when(mod97_ok(F.regexp_replace(s["value"], " ", "")), 1.0),
        "local_phone": lambda s: F.when(near(s), 0.6).otherwise(0.3),
    }

    def of_kind(rank: int, kind: str) -> Column:
        return F.transform(
            F.col(f"_{kind}"),
            lambda s: F.struct(
                s["start"].alias("start"),
                F.lit(rank).alias("rank"),
                s["end"].alias("end"),
                F.lit(kind).alias("kind"),
                confirmed[kind](s).cast("double").alias("score"),
                s["value"].alias("value"),
            ),
        )

    all_spans = F.concat(*[of_kind(rank, kind) for rank, kind in enumerate(KINDS)])
    kept = F.array_sort(F.filter(all_spans, lambda s: s["score"] >= MIN_SCORE))
    return rows.withColumn("spans", kept).select(F.col("_id").alias(id_column), "spans")


def digest_spans(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts of the base kinds and the spans as text, ``kind:start:end`` joined by commas."""

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["rank"] < 4)
    return found.select(
        id_column,
        *[count(kind) for kind in KINDS[:4]],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
