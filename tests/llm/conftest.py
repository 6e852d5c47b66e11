from __future__ import annotations

import pytest

#: Nulls in every column, empty and long texts, ties, repeated rows.
EDGES = [
    (None, None), (None, "a null id with some words in it"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "two words"), (6, "x" * 200_000), (7, "word " * 30_000),
    (8, "Ünï çødé 日本語 🤦🏼 and\x00control\x1cchars here"), (9, "mail a@b.co call +1 (017) 555-7713"), (9, "another text of the same id"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Documents with edge cases and extra columns whose names clash with results."""
    rows = [(i, t, "en", "s", None, 0.5, "x", 7, "k") for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, n_words long, key string").repartition(3)


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)
