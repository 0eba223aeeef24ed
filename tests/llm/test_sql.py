"""Queries of the subpackage that SQL can express, against DuckDB."""

import pytest
from sparkloom.llm import queries as Q

from ..oracle import compare, connect


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query(spark, sf_small, name):
    assert compare(spark, connect(sf_small), name, Q.QUERIES[name], Q.ORACLES[name], sf_small) is None
