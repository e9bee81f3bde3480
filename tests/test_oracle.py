"""Every query with a SQL cross-check agrees with DuckDB on the small tables."""
from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
import oracle

SQL = entry_points.oracle_sql()
QUERIES = entry_points.queries()


@pytest.fixture(scope="module")
def duck(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches(spark, small, duck, name):
    assert oracle.difference(QUERIES[name](spark, small), duck, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
