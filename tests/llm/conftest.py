from __future__ import annotations

import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text) pairs."""
    def make(pairs):
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, make_docs):
    """Null and empty texts, null and repeated ids, repeated rows, a very long text, names that clash."""
    long = " ".join(f"word{k % 977} {k}" for k in range(40_000))
    pairs = [
        (None, None), (None, "a text without an id"), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"),
        (6, "a text of some words that comes twice"), (6, "a text of some words that comes twice"), (6, "another text"),
        (7, "a text  of some words\nthat comes twice"), (8, long), (9, long + " end"), (-3, "é" * 300 + "日本語" * 50),
    ]
    extra = ["row", "hash", "key", "keep_id", "n", "score", "spans", "part", "component_id", "TEXT2"]
    df = make_docs(pairs)
    for name in extra:
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, [(r["doc_id"], r["text"] or "") for r in df.collect()]


@pytest.fixture
def rng():
    return random.Random(7)
