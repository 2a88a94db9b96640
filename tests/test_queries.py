"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tools import compare

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    mine = compare.spark_rows(entry.queries()[name](spark, SF))
    if name in SQL:
        assert compare.difference(mine, compare.sql_rows(con, SQL[name])) is None
    # The smallest sample holds no secrets.
    assert mine[1] or name == "scr2_scan_documents"
