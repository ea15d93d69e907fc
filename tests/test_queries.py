"""Every feed query against DuckDB."""

import pytest
from oracle import check

from tapeloom.queries import ORACLE_SQL, QUERIES


def test_each_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    check(spark, name)
