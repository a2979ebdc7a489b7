from __future__ import annotations

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, h long, size long, target double, label int, key string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, source), with columns whose names the operators use themselves."""

    def make(rows):
        full = [(i, t, "en" if i is None or i % 3 else None, s, len(t or ""), "r", 1, 2, 3.0, 4, "k") for i, t, s in rows]
        return spark.createDataFrame(full, COLUMNS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, ties."""
    long_text = "word " * 60_000 + "x" * 50_000
    return [(1, None, "a"), (2, "", "a"), (3, "one two three", None), (3, "one two three", None), (4, long_text, "b"), (5, "  \n\t ", "b"), (None, "no id here at all, none", "c"), (7, "one two three", "a")]
