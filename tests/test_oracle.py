"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import pytest

import __spark_entry__ as contract
from check_queries import compare, connect
from runloom import catalog

SF = "/root/testdata/sf0.001"
ORACLE = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) <= set(ORACLE)
    assert set(ORACLE) <= set(contract.queries())


@pytest.mark.parametrize("key", sorted(catalog.QUERIES))
def test_query(spark, duck, key):
    assert compare(duck, contract.queries()[key](spark, SF), ORACLE[key]) is None


def test_entry(spark):
    assert not contract.entry(spark).isEmpty()
