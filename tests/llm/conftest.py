from __future__ import annotations

import random

import pytest

# every column that an operator makes on its way or gives back, to clash with
CLASHES = ["size", "shard", "slot", "node", "class", "key", "words", "spans", "score", "_row", "ids", "block", "n_words", "base"]


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with the given (doc_id, text, source), and columns whose names clash with those of operators."""

    def build(*rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
        data = [(i, t, "en", s, None if t is None else len(t), *["x"] * len(CLASHES)) for i, t, s in (r if len(r) == 3 else (*r, "a") for r in rows)]
        return spark.createDataFrame(data, schema)

    return build


@pytest.fixture(scope="session")
def prose():
    """prose(seed, n): n invented words."""

    def make(seed: int, n: int, vocabulary: int = 3000) -> str:
        rnd = random.Random(seed)
        return " ".join(f"w{rnd.randrange(vocabulary)}é" if rnd.random() < 0.1 else f"w{rnd.randrange(vocabulary)}" for _ in range(n))

    return make
