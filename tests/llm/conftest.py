import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard string, kept boolean"
WORDS = [f"word{k}" for k in range(400)]


def prose(seed: int, n: int = 120) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long = prose(5, 30_000)
    base = prose(1)
    rows = [
        (1, base, "en", "a", 10, 0.5, "x", True),
        (2, base, "en", "a", 10, None, None, None),
        (2, base, "en", "a", 10, None, None, None),
        (3, base.replace("word1 ", "other "), None, "a", None, 0.1, "", False),
        (4, None, "en", "b", 0, 0.1, "", False),
        (5, "", "en", None, 0, 0.1, "", False),
        (6, " \t\n ", None, None, None, None, None, None),
        (None, prose(2), "en", "b", 3, 0.2, "y", True),
        (None, prose(2), "en", "b", 3, 0.2, "y", True),
        (7, long, "en", "c", 4, 0.2, "y", True),
        (8, "one two three", "en", "c", 4, 0.2, "y", True),
        (9, "one two three", "en", "c", 4, 0.2, "y", True),
        (10, "\x00\x01 ÿ 日本語 ### $$$ a|b", "en", "c", 4, 0.2, "y", True),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (2, 1, 1), (3, None, None), (None, 1, 1), (7, 1, 0), (8, 0, 1), (9, 0, 1), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
