import pytest

TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog again and again until the evening comes"),
    (1, "the quick brown fox jumps over the lazy dog again and again until the evening comes"),
    (2, None),
    (3, ""),
    (4, "  \n\t "),
    (None, "a text that has no id but has some words in it"),
    (5, "x" * 5000),
    (6, "word " * 4000),
    (7, "é😀 ünï <|endoftext|> </s>[INST] a@b.org 1.2.3.4"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with names that operators use."""
    rows = [(i, t, "k", "b", 1, "x") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, base string, block int, kept string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
