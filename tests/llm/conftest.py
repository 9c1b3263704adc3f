import random

import pytest


@pytest.fixture(scope="session")
def words():
    r = random.Random(4)
    return ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd(spark, words):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and columns with clashing names."""
    r = random.Random(5)
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    same = text(80)
    rows = [
        (1, None, "en", None, 1, "x"), (2, "", "en", "s", 0, None), (None, same, None, "s", 3, "x"), (3, same, "en", "s", 3, "x"), (3, same, "en", "s", 3, "x"),
        (4, text(30_000), "de", "s", 9, "x"), (5, "!!! \n\t 123", "en", "s", 9, "x"), (6, "a", None, None, None, None), (7, same + " end", "en", "s", 3, "x"), (8, text(200), "fr", "s", 3, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.filter("doc_id = -1")
