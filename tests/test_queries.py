"""Every registered query against its SQL on DuckDB."""

import pytest

from oreflow.catalog import QUERIES, SQL
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def db(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, folder, db, name):
    frame = QUERIES[name](spark, folder)
    if name in SQL:
        assert compare(frame, db, SQL[name]) == ""
    else:
        assert frame.count() >= 0


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
