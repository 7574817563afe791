"""Small tables with the awkward rows every operator has to take."""

from __future__ import annotations

FOLDER = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 20_000

# Null ids and texts, empty and blank texts, repeated rows, ties in everything but the id, a very long text.
ROWS = [
    (1, "Alpha beta"), (2, "alpha BETA"), (2, "alpha BETA"), (3, None), (None, ""), (4, "   \n\t "), (5, "Über uns"),
    (6, "über uns"), (7, LONG), (8, "call me at +1 (017) 555-7713 or a@b.example.com"), (9, "x"), (None, "Alpha beta"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, None, None if i == 3 else "src0", len(t or "")) for i, t in rows], SCHEMA)


def clashing(df):
    """The same table with further columns, named like those the operators make."""
    for name in "_id _text _key _sha _set _n keep_id kept score spans ids n_tokens component_id copy_no _draw".split():
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)
