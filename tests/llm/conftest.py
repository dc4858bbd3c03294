"""Helpers for the training-data operators; the session comes from the tests above."""

import pytest


@pytest.fixture
def frame(spark):
    """A table from rows and a schema, with further columns of names used inside."""

    def make(rows, schema, clash=True):
        df = spark.createDataFrame(rows, schema)
        if clash:
            for name in ("key", "node", "n", "score", "size", "removed", "row", "part", "a"):
                if name not in df.columns:
                    df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


@pytest.fixture
def few(spark):
    """Few partitions for tiny tables."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
