"""Every registered query against its DuckDB statement, at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from larder.plans.registry import QUERIES
from oracle.statements import statements
from tests.conftest import SMALL
from tests.parity import compare, connect

STATEMENTS = statements()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    if name in STATEMENTS:
        assert compare(df, duck, STATEMENTS[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_a_statement_and_is_registered():
    assert set(QUERIES) == set(STATEMENTS)
    assert set(QUERIES) <= set(entry.queries())
