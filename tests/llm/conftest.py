import random

import pytest
from samples import SCHEMA, extra


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows and ids, ties, other scripts, and one very long text."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a, b = text(120), text(60)
    near = a.split()
    near[50] = "changed"
    return [
        (1, a), (2, a), (2, a), (3, " ".join(near)), (4, b + " " + text(20)), (5, text(20) + "\n" + b), (6, None), (None, a), (None, None),
        (7, ""), (8, "  \n\t "), (9, "one"), (10, "one"), (11, "漢字 🙂 éà " * 30), (12, text(40_000)), (13, "x" * 90_000), (14, "A b C d"), (15, "a B c D"), (16, "\x00 \x85   ok"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(extra(odd_rows), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
