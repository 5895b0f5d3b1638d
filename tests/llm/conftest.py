"""Fixtures for the operators of the llm subpackage."""

from __future__ import annotations

import pytest

# Texts with every edge case that each operator has to define.
EDGES = [
    (1, "The house of the small dog stood in a wide green field near the old river of the town."),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (5, "one"),
    (6, "The house of the small dog stood in a wide green field near the old river of the town."),
    (7, "ÄÖÜ ΑΣ ß 日本語 😀 don't <|endoftext|> x"),
    (8, "word " * 3000),
    (9, "a" * 5000),
    (None, "A row without an id, but with a text of its own."),
]


@pytest.fixture
def edges(spark):
    """The edge rows, with further columns whose names the operators use themselves."""
    rows = [(i, t, "x", 1, "en", "s", 0) for i, t in EDGES]
    return spark.createDataFrame(
        rows, "doc_id long, text string, hash string, score int, lang string, source string, n_chars long"
    )


@pytest.fixture
def nothing(edges):
    return edges.where("false")
