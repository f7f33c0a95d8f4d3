"""Every registered query with an SQL twin gives the same rows on the smallest tables."""

import pytest

import __spark_entry__ as entry
from riskspark.catalog import ORACLES
from tools.check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    ok, text, _ = compare(name, spark, FOLDER, con, entry.queries(), entry.oracle_sql())
    assert ok, text


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "customer_id" and df.count() == 150
