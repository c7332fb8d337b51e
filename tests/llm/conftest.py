"""Small documents with awkward cases: nulls, empty and long texts, repeated rows, clashing column names."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, n long, rep long, `__row` string, key string"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join("w" + str(rng.randrange(vocabulary)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(5)
    base = [words(rng, 80) for _ in range(6)]
    texts = [None, "", "   \n", "one", "One  TWO", "a b c d e", base[0], base[0], base[0] + " extra", base[1], base[1].replace("w1 ", "x "), base[2]]
    texts += [base[2] + " " + words(rng, 3), base[3], base[4], base[5], words(rng, 30000), "ünïcödé 漢字 🙂 text " * 5, "<|endoftext|> inside <|endoftext|>", "!!! 123 ..."]
    out = [(i, t, ["en", "de", None][i % 3], i, -i, "r", "k") for i, t in enumerate(texts)]
    return [*out, out[9], (None, base[3], "en", 0, 0, "r", "k")]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
