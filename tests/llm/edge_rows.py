"""Documents that no operator may trip over."""

from __future__ import annotations

CLASHING = ("id", "_id", "_row", "fp", "root", "low", "spans", "blob", "doc", "own_text", "own_spans", "score", "part", "rank")
LONG = "lorem ipsum dolor " * 20_000


def edge_documents(spark, extra=()):
    """Nulls in any column, empty and long texts, ties, repeated rows, columns of clashing names."""
    rows = [
        (1, None, "en", "a", None),
        (2, "", None, None, 0),
        (None, "one text without an id of its own", "en", "a", 33),
        (4, "the same text twice over and over again", None, "b", 39),
        (5, "the same text twice over and over again", "en", None, 39),
        (5, "the same text twice over and over again", "en", None, 39),
        (6, LONG, "en", "a", len(LONG)),
        (7, " \t\n ", "en", "a", 4),
        (8, "é😀 ß password=abc12345 mail me@example.com", "de", "b", 40),
        (None, None, None, None, None),
        *extra,
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    return docs.selectExpr("*", *[f"cast({i} as int) as `{c}`" for i, c in enumerate(CLASHING)])


def empty_documents(spark):
    return edge_documents(spark).where("false")
