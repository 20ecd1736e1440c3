"""Every registered query against its SQL on the smallest tables."""

import pytest

from tessera.catalog import FLAGSHIP, ORACLES, QUERIES
from tests.compare import connect, rows_of, rows_of_sql

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    columns, got = rows_of(QUERIES[name](spark, FOLDER))
    wanted_columns, wanted = rows_of_sql(duck, ORACLES[name])
    assert columns == wanted_columns
    assert got == wanted


def test_queries_without_sql_run(spark):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, FOLDER).columns


def test_entry(spark):
    import __spark_entry__ as entry

    assert FLAGSHIP in entry.queries()
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
