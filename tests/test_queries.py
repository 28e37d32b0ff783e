"""Every core query against its SQL; the entry points."""

import pytest

import __spark_entry__ as entry_points
from aislewise.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: Queries that SQL can't express, and the tests of their operators.
TESTED = {"M5": "test_training.py"}
ONCE = sorted({id(q): name for name, q in reversed(QUERIES.items())}.values())  # some names share a query


@pytest.mark.parametrize("name", ONCE)
def test_query(same, name):
    same(QUERIES[name], SQL.get(name), name in TESTED)


def test_entry_points(spark):
    assert set(SQL) <= set(QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() > 0
