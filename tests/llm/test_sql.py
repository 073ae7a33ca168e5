"""Queries that SQL can express, against it."""

from __future__ import annotations

import pytest
from oracle import assert_same

from strataframe.llm import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, QUERIES[name], SQL[name])


def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, len(QUERIES) + 1))
    assert {n.split("_")[0] for n in set(QUERIES) - set(SQL)} == {"op2", "op5", "op6", "op7", "op8", "op9", "op12"}
