"""Every registered query against its SQL counterpart, over the whole given tables."""

import pytest
from oracle import difference

import __spark_entry__ as entry
from tracemill.plans import registry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, tables, name):
    assert difference(spark, name, QUERIES[name], SQL[name], tables) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, tables, name):
    """Only that it runs and gives rows; what these give is held against plain versions elsewhere."""
    assert QUERIES[name](spark, tables).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["arm"] for r in rows} == {"one", "ask", "control"}


def test_every_query_has_sql():
    """A tokenizer's counts alone have none; test_flows holds them against the library."""
    assert set(registry.QUERIES) - {"token_lengths"} == set(registry.SQL) <= set(QUERIES)
