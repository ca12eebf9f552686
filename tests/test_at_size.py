"""Queries over tables with what larger ones hold: keys that meet, equal lines, many types of a number."""

import pytest

from quaestor.plans.queries import ORACLE_SQL, QUERIES
from tests.oracle import TABLES, compare, connect


@pytest.fixture
def tables(spark, data, tmp_path):
    """A function that writes tables of its own, in SQL over those at hand, and compares a query with its SQL on them."""
    con = connect(data)

    def check(name, **made):
        for t in TABLES:
            con.execute(f"COPY ({made.get(t, f'SELECT * FROM {t}')}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        return compare(connect(tmp_path), QUERIES[name](spark, str(tmp_path)), ORACLE_SQL[name])

    return check


def test_lines_of_one_number_are_ordered_by_supplier(tables):
    """The rate of supplier 26 counts, 100, though that of supplier 9, 900, is greater."""
    line = "SELECT * REPLACE (6 AS l_orderkey, 1 AS l_linenumber, 2 AS l_partkey, s AS l_suppkey) FROM (SELECT * FROM lineitem LIMIT 1), (VALUES (9), (26)) v(s)"
    assert tables("bid_premium_rates", lineitem=f"SELECT * EXCLUDE (s) FROM ({line})") == ""


def test_lots_of_one_id_are_texts_of_their_own(tables):
    """Lines 1 of order 1 and 1 of order 2 share an id, since their parts are a million apart."""
    line = "SELECT * REPLACE (o AS l_orderkey, 1 AS l_linenumber, p AS l_partkey) FROM (SELECT * FROM lineitem LIMIT 1), (VALUES (1, 1000007), (2, 7)) v(o, p)"
    assert tables("lot_provenance", lineitem=f"SELECT * EXCLUDE (o, p) FROM ({line})") == ""
