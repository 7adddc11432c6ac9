"""Small fixtures for the corpus operators."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"



@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, sources=None, langs=None):
        rows = [(i, t, (langs or {}).get(i, "en"), (sources or {}).get(i, "s"), None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, blank and long texts, ties, repeated rows, and columns with clashing names."""
    long = "word " * 60_000 + "\n" + "x" * 300_000
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", None, "a"), (4, long, "en", None), (None, "a b c", "en", "b"), (5, "a b c", "en", "b"), (5, "a b c", "en", "b"), (6, "é È\n\n12 %%", "fr", "b")]
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema)
    from pyspark.sql import functions as F

    for name in ("size", "key", "score", "shard", "group", "n", "target", "part", "keys", "templates", "node", "n_lines"):
        df = df.withColumn(name, F.lit("clash"))
    return df
