"""Every query with SQL, against DuckDB on the smallest tables."""

import pytest
from sparkloom.plans import queries as Q

from .oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_small):
    return connect(sf_small)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query(spark, con, sf_small, name):
    assert compare(spark, con, name, Q.QUERIES[name], Q.ORACLES[name], sf_small) is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
