"""Small documents with everything that may go wrong in them."""

import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def words():
    rng = random.Random(1)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(3000)]


@pytest.fixture(scope="session")
def odd_rows(words):
    """Nulls in each column, empty and blank texts, a very long text, ties, repeated rows."""
    rng = random.Random(2)
    text = prose(rng, 120, words)
    long = "\n".join(prose(rng, 40, words) for _ in range(500))
    return [
        (1, text, "en", "a", None),
        (1, text, "en", "a", None),
        (2, text, "en", None, 5),
        (3, text + " tail", None, "b", 1),
        (4, None, "en", "a", 0),
        (5, "", None, None, 0),
        (6, " \t\n ", "de", "a", 4),
        (None, text, "en", "a", 1),
        (None, None, None, None, None),
        (7, long, "fr", "b", len(long)),
        (8, "!!! 123 ###", "en", "b", 10),
        (9, "word", "en", "c", 4),
        (10, "Ünï ‮cödé 漢字 " * 30, "de", "c", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def crowded(odd):
    """The odd rows with columns whose names operators may use for themselves."""
    from pyspark.sql import functions as F

    names = ["c0", "c1", "key", "size", "copies", "_copies", "_doc_id", "_gone", "node", "component", "spans", "n_lines", "removed_lines", "lang_pred", "score", "_text", "_letters", "fit", "bucket", "target", "draw"]
    return odd.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
