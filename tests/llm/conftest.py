from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, k long, n int, key string, fp long, fold int, digest string"
LONG = "word other thing " * 30_000
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n", None, "s", 3), (4, "the cat and the hat of", "en", "s", 22), (4, "the cat and the hat of", "en", "s", 22), (5, "The Cat  and the hat OF", "en", "s", 23),
    (6, LONG, "en", "s", None), (7, "x" * 30_000, "en", None, 30_000), (None, "no id here at all", "en", "s", 17), (8, "the cat and\nthe hat of", None, "s", 22), (9, "12 34 !!", "en", "s", 8), (10, "été <|endoftext|> 日本 😀", "fr", "s", 20),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in all columns, empty and very long texts, ties and repeated rows, columns with the operators' own names."""
    return spark.createDataFrame([r + ("r", 1, 2, "x", 3, 4, "d") for r in ODD], SCHEMA).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
