"""Registered queries against their SQL answers in DuckDB, at the smallest scale."""

import pytest

import __spark_entry__ as contract
from docsieve.catalog import ORACLES
from tests.oracle import check, connect

SF_DIR = "/root/testdata/sf0.001"
NAMES = sorted(ORACLES)


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns == ["token", "df", "df_positive", "share"] and 0 < rows.count() <= 20


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    problem = check(contract.queries()[name](spark, SF_DIR), contract.oracle_sql()[name], con)
    assert problem is None, problem
