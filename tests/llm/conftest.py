"""Odd documents that every operator must take."""

from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, class int, fp long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns with clashing names."""
    rows = [
        (1, None, "en", "a", None, 1.0, True, 1, 1), (2, "", None, None, 0, None, None, None, None), (3, " \t\n ", "en", "a", 4, 0.5, False, 2, 2), (None, "no id here at all", "en", "b", 5, None, None, None, None),
        (4, "word " * 20_000, "en", "a", 100_000, None, None, None, None), (5, "same text twice, twice the same", "en", "a", 1, None, None, None, None), (5, "same text twice, twice the same", "en", "a", 1, None, None, None, None),
        (6, "12 34 !! ??", "de", "", 3, None, None, None, None), (7, "naïve café — 日本語 \U0001F600 <|endoftext|> x  y", "fr", "c", 9, None, None, None, None), (-8, "negative id", "en", "a", 2, None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
