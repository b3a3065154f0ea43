"""Every library query against its SQL in DuckDB, and those without SQL against plain Python."""

from __future__ import annotations

import oracle
import pytest

from palimpsest import queries as library


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(library.SQL))
def test_equals_sql(spark, sf, con, name):
    assert oracle.differences(library.QUERIES[name](spark, sf), con, library.SQL[name]) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["query_id", "id", "score", "rank"]


def test_recursive_states(spark, sf):
    """Budgets and buckets keep one row an event and never spend beyond their limit."""
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    for name in ("r13_token_bucket", "m03_privacy_budget"):
        assert library.QUERIES[name](spark, sf).count() == n
