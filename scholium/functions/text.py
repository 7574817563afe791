"""Text expressions: trimming, markup removal, sentences and words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholium.functions.columns import ColumnOrName, as_column

# The characters that the web platform's trim() removes.
WHITE_SPACE = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WORD = r"\p{L}+"
SENTENCE_BREAK = rf"[.!?][{WHITE_SPACE}]+|\n+"
# Markup whose content is not reading text, then any remaining tag.
HIDDEN_MARKUP = (
    r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
    r"|<nav\b.*?</nav\s*>|<head\b.*?</head\s*>|<footer\b.*?</footer\s*>"
)
TAG = r"(?s)<[^>]*>"
# Named characters decoded after the tags are gone; the ampersand comes last.
ENTITIES = {
    "&nbsp;": " ",
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&amp;": "&",
}


def trim_all(text: ColumnOrName) -> Column:
    """Strip every kind of white space from both ends."""
    return F.btrim(as_column(text), F.lit(WHITE_SPACE))


def contains_text(text: ColumnOrName, query: str) -> Column:
    """Case-insensitive contains; a blank query matches everything."""
    wanted = F.lower(trim_all(F.lit(query)))
    return (wanted == "") | F.contains(F.lower(as_column(text)), wanted)


def sentences(text: ColumnOrName) -> Column:
    """Non-blank sentences and lines, trimmed, in order."""
    pieces = F.transform(F.split(as_column(text), SENTENCE_BREAK), trim_all)
    return F.filter(pieces, lambda piece: piece != "")


def words(text: ColumnOrName) -> Column:
    """Lower-cased runs of letters, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(as_column(text)), F.lit(WORD), F.lit(0))


def page_title(html: ColumnOrName) -> Column:
    title = F.regexp_extract(as_column(html), r"(?is)<title[^>]*>(.*?)</title\s*>", 1)
    return decode_entities(squeeze(title))


def squeeze(text: ColumnOrName) -> Column:
    return trim_all(F.regexp_replace(as_column(text), f"[{WHITE_SPACE}]+", " "))


def decode_entities(text: ColumnOrName) -> Column:
    decoded = as_column(text)
    for entity, character in ENTITIES.items():
        decoded = F.replace(decoded, F.lit(entity), F.lit(character))
    return decoded


def plain_text(html: ColumnOrName) -> Column:
    """Reading text of a page: hidden parts and tags removed, named characters decoded."""
    visible = F.regexp_replace(as_column(html), HIDDEN_MARKUP, " ")
    return squeeze(decode_entities(F.regexp_replace(visible, TAG, " ")))


def blank_out(sentence: ColumnOrName, term: ColumnOrName, gap: str = "____") -> Column:
    """Replace whole-word uses of a lower-case word by a gap, whatever their case.

    Neighbouring uses share a separator, so the replacement runs twice.
    """
    pattern = F.concat(F.lit(r"(?iu)(^|[^\p{L}])"), as_column(term), F.lit(r"($|[^\p{L}])"))
    once = F.regexp_replace(as_column(sentence), pattern, F.lit(f"$1{gap}$2"))
    return F.regexp_replace(once, pattern, F.lit(f"$1{gap}$2"))
