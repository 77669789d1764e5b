import random

import pytest
from brute import SCHEMA, prose


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows; extra columns have clashing names."""
    rng = random.Random(5)
    base = prose(rng, 120)
    edited = base.split(" ")
    edited[7] = "changed"
    passage = prose(rng, 60)
    texts = [
        base, base, " ".join(edited), None, "", " \t\n ", "one", "One two", "one two",
        prose(rng, 30_000), "\n".join(["the same line of seven plain words"] * 40),
        prose(rng, 80) + " " + passage + " " + prose(rng, 40), prose(rng, 20) + "\n" + passage + "\n" + prose(rng, 90),
        "Straße ÀÉÎ ñandú 中文 😀 ▁ <|endoftext|> </s>", "A!! B!! C!!\n$$$ ### %%% &&& ***\nx | y | z", "x" * 70_000,
    ]
    rows = [
        (10 + i, t, [None, "en", "de"][i % 3], [None, "a", "b", "a"][i % 4], None if i % 5 == 0 else 3, 7, "x", None, "y")
        for i, t in enumerate(texts)
    ]
    rows += [rows[0], rows[11], rows[6]]
    rows += [(None, base, "en", "a", 1, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
