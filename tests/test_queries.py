"""Every registered query that has SQL returns the rows of its SQL."""

import pytest

from quaestor.plans.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(name, spark, data, con):
    assert compare(con, QUERIES[name](spark, data), ORACLE_SQL[name]) == ""


def test_entry_imports(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
