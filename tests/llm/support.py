"""Documents with everything that may be odd, and small helpers."""

LONG = "word " * 30_000 + "end."
ODD_COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, node string, score string, spans string, "
    "hash string, turns string, shard string, `key` string"
)
_CLASH = ("x",) * 7


def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (None, "a text without an id, and it is long enough", "en", "a", 43),
        (3, LONG, "en", "a", len(LONG)),
        (4, "twice the same row in this table of rows", "de", "b", 40),
        (4, "twice the same row in this table of rows", "de", "b", 40),
        (5, "twice the same row in this table of rows", "de", "b", 40),
        (6, " \t\n\x0b ", "en", None, 5),
        (7, "naïve “quotes” — emoji 🎉 é end.", "fr", "c", 30),
        (8, "x" * 50_000, "fr", "c", 50_000),
    ]
    return spark.createDataFrame([r + _CLASH for r in rows], ODD_COLUMNS)


def no_documents(spark):
    return spark.createDataFrame([], ODD_COLUMNS)


def documents(spark, texts, first=0):
    """Documents with ids in order."""
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
