import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, blob string, fp long, score double, h1 long"


@pytest.fixture(scope="session")
def prose():
    """A maker of made-up sentences."""

    def make(seed: int, words: int = 60) -> str:
        rnd = random.Random(seed)
        syllables = ["ba", "ko", "ri", "tum", "sel", "ne", "vor", "ga", "li", "mo"]
        out = []
        for i in range(words):
            w = "".join(rnd.choice(syllables) for _ in range(rnd.randint(2, 4)))
            out.append(w + ("." if i % 9 == 8 else ""))
        return " ".join(out)

    return make


@pytest.fixture(scope="session")
def edge(spark, prose):
    """Nulls in any column, empty, one-word and very long texts, ties, repeated rows, and extra columns whose names operators use inside."""
    long = " ".join(prose(i, 400) for i in range(40))
    rows = [
        (1, prose(1)), (2, None), (3, ""), (4, "   \n\t "), (5, "word"), (6, long), (7, prose(1)), (7, prose(1)), (None, prose(3)), (None, None), (8, "É " * 30),
    ]
    return spark.createDataFrame([(i, t, None, None if i == 5 else "s", None, "x", 1, 0.5, 2) for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
