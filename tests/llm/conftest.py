"""Rows that every operator must take: nulls, empty and very long texts, repeats, clashing columns."""

import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}" + "x" * (i % 5) for i in range(60_000))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def rows(documents):
    return [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()]


EDGE = [
    (None, "one two three four five six", "en", None, 3), (1, None, None, "b", None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4),
    (4, "word", "en", "a", 4), (4, "word", "en", "a", 4), (5, LONG, "en", "b", len(LONG)), (6, LONG + " end", "en", "b", len(LONG) + 4),
    (7, "one two three four five six", "en", None, 3), (8, "mixed 日本語 é😀\x1c\xa0 text ", "ja", "ü", 9), (-9, "y" * 200_000, "en", "b", 200_000),
    (10, "one TWO three\nfour five six", "en", "c", 27),
]


@pytest.fixture(scope="session")
def edge(spark):
    """The awkward rows, with extra columns named as operators name theirs."""
    df = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string, n_chars long")
    names = ["size", "shard", "_shard", "start", "kind", "rid", "set_id", "row", "_id", "_text", "_hash", "node", "label", "run", "piece", "toxic", "rejected", "value", "text_hash"]
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture
def rng():
    """The same numbers in every test, whatever ran before it."""
    return np.random.default_rng(7)
