from __future__ import annotations

import random

import pytest


@pytest.fixture
def prose():
    """Texts that look like prose: words from a small vocabulary, always the same for a seed."""

    def make(seed: int, words: int) -> str:
        rng = random.Random(seed)
        vocabulary = ["".join(random.Random(i).choices("abcdefgh", k=3 + i % 6)) for i in range(400)]
        return " ".join(rng.choices(vocabulary, k=words))

    return make


@pytest.fixture
def docs_of(spark):
    """Documents from (id, text) pairs, with extra columns whose names clash with the operators' own."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n long, id long"
        return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), True, 1, 1) for i, t in rows], schema)

    return make
