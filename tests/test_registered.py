"""Every registered query against DuckDB at the smallest scale."""

import pytest
from compare import check
from oracle import connect

import __spark_entry__ as entry_module
from canopy.catalog import load

FOLDER = "/root/testdata/sf0.001"
CATALOG = load()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(CATALOG.queries))
def test_query_equals_oracle(spark, con, name):
    assert check(spark, con, name, CATALOG, FOLDER, need_rows=False) is None


def test_entry_has_rows_and_every_oracle_has_a_query(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
