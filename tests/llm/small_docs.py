"""Small tables for the tests of this folder."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their own columns.
CLASHING = ("ids", "mark", "key", "uid", "root", "size", "start", "block", "fingerprint", "score", "part", "spans", "links", "gone", "near", "shard", "slot", "first", "kind", "line", "pos")


def docs(spark, *rows):
    """Rows are (doc_id, text, lang, source), later ones optional."""
    full = [(*r, *[None] * (4 - len(r))) for r in rows]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], DOCS)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})


AWKWARD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", "a"), (None, "a text without an id", "en", None),
    (4, "two words", "en", "b"), (5, "the same text twice over", "en", "b"), (5, "the same text twice over", "en", "b"),
    (6, "the same text twice over", "de", "a"), (7, "wort " * 30_000, "de", "a"), (8, "é🎉 ß\x1c\x85ﬁ", None, "b"), (9, "!!! ??? 123", "en", "b"),
]

