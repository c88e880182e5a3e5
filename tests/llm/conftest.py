import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n):
    return [rng.choice("abcdefghijklmnop") + str(rng.randrange(5000)) for _ in range(n)]


@pytest.fixture(scope="session")
def rng():
    return random.Random(5)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs."""

    def of(rows, **more):
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return of


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and blank texts, ties, repeated rows, a very long text and one without spaces."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return make(
        [
            (1, "one two three"), (2, "one two three"), (2, "one two three"), (3, None), (3, None), (None, "one two three"), (None, None),
            (4, ""), (5, ""), (6, " \n\t "), (7, long), (8, "x" * 5000), (9, "naïve café – 日本語 \U0001f600"), (10, "!!! ??? ..."),
        ]
    )


@pytest.fixture(scope="session")
def clash(odd):
    """The same with further columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    names = ["th", "same", "keep", "shard", "shard_part", "range", "cut", "id", "part", "n_removed", "_th", "_did", "h1", "unit", "bin_id", "tokens", "language", "key", "lot"]
    return odd.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))


@pytest.fixture(scope="session")
def none(make):
    return make([])
