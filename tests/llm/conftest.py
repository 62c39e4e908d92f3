from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Words of 13 and more, shared in parts between rows.
LINE = " ".join(f"word{i}" for i in range(40))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, LINE, "en", "a", 5),
        (2, LINE + " tail", "en", "a", 5),
        (3, "  " + LINE.replace(" ", "\t\n ") + "\r", None, "a", None),
        (3, "  " + LINE.replace(" ", "\t\n ") + "\r", None, "a", None),  # a repeated row
        (4, None, "en", None, 5),
        (5, "", None, "b", 5),
        (6, " \t ", "fr", "b", 5),
        (None, LINE, "fr", None, 5),
        (7, "un deux", "fr", "c", 5),
        (8, "un deux", "fr", "c", 5),
        (8, "other text of the same id", "en", "c", 5),
        (9, "123 456 ... !!", "en", "d", 5),
        (10, "the long one " * 20000, "en", "d", 5),
        (11, "x" * 300_000, "en", "d", 5),
        (12, "é ß 漢字 😀 İ Σ", "de", "é", 5),
    ]
    df = spark.createDataFrame(rows, DOCS)
    clash = {c: df["doc_id"] * 0 for c in ("_id", "_h", "_t", "_n", "f", "k", "kept", "size", "copies", "_copy", "spans", "score", "lang_pred", "ids", "rank", "_p", "root", "key", "name", "kind")}
    return df.withColumns(clash).repartition(3)


@pytest.fixture(scope="session")
def plain_odd(odd):
    """The same rows as tuples."""
    return [tuple(r) for r in odd.select("doc_id", "text", "lang", "source").collect()]


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
