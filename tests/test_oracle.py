"""Every registered query with a DuckDB text, side by side at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# The composed job is one plan in several shapes; not all of them are needed here.
SLOW = {"compliance_results"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES and n not in SLOW])
def test_equal(spark, sf_dir, con, name):
    ok, note = compare(QUERIES[name](spark, sf_dir), con, ORACLES[name])
    assert ok, note


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
