import pytest
from pyspark.sql import functions as F

TEXTS = [
    (1, "The cat sat on the mat and slept all day long."), (2, "the CAT sat on the mat and slept all day long."), (3, None), (4, ""), (5, "   \t\n"),
    (6, "Ärger ÄRGER é è 一二三 👍🏽 x"), (7, "word " * 3000), (8, "The cat sat on the mat and slept all day long."), (9, "one"), (10, "one two"),
    (8, "The cat sat on the mat and slept all day long."), (None, "no id here"), (11, "a\x1cb\x85c d"),
]


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with names that operators use inside."""
    d = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return d.withColumns({c: F.lit("x") for c in ("row", "key", "recipe", "fp", "rep", "uid", "score", "norm", "shard", "held_out")})


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.where("false")
