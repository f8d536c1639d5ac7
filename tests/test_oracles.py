"""Every registered query against its SQL on the same tables."""

import pytest
from compare import connection, difference

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


def test_every_query_has_an_oracle():
    assert set(contract.QUERIES) == set(contract.ORACLES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(contract.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = contract.queries()[name](spark, SF)
    assert difference(df, con, contract.oracle_sql()[name]) is None
