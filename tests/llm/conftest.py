import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in any column, empty and blank texts, repeated rows, ties, a long text.
ODD = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", None, "a", 4),
    (4, "one", "en", None, 3),
    (4, "one", "en", None, 3),
    (None, "no id here at all", "fr", "b", 17),
    (5, "12 34 !!", "fr", "b", 8),
    (6, "word " * 30000, "en", "b", 150000),
    (7, "x" * 50000, "en", "b", 50000),
    (8, "école über \U0001f600   café", "fr", None, 20),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with extra columns named like what operators add."""
    from pyspark.sql import functions as F

    names = ["size", "kept", "position", "bucket", "rep", "host", "fp1", "_fp1", "_doc", "_text", "_spans", "lines", "length", "rank", "slot", "shard", "target", "component_id", "_kept"]
    return odd.withColumns({n: F.lit(1) for n in names})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
