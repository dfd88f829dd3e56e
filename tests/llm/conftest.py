"""Small documents with every awkward case: nulls, empty and long texts, ties, repeats."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, key long, score double"


def words(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward_rows():
    base = words(1, 120)
    rows = [
        (0, base, "en", "s0"), (1, base, "en", "s0"), (2, base.replace(" a", " zz", 1), "en", "s1"),
        (3, "", "en", "s1"), (4, None, None, None), (5, "one", "de", "s0"), (6, "one two", "de", None),
        (7, words(2, 3000), "en", "s0"), (8, "é ü \U0001f600 x " * 40, "fr", "s2"), (9, " \t\n ", "fr", "s2"),
        (10, words(3, 60) + "\n" + words(4, 40), "en", "s0"), (11, words(5, 30) + "\n" + words(4, 40), "en", "s2"),
        (None, words(6, 50), "en", "s0"), (12, words(7, 40), "en", "s1"), (12, words(7, 40), "en", "s1"),
        (13, "x" * 5000, "en", "s0"), (14, words(8, 200), "en", "s1"), (15, words(9, 80), "en", "s0"),
    ]
    # The last columns have names that operators use inside.
    return [(i, t, lang, s, len(t or ""), "digest", 1, 0.5) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
