"""Every registered query with SQL gives what the SQL gives; the others run and give rows."""

from __future__ import annotations

import pytest

from siltworks import catalog
from tests.oracle import compare, connect, kinds

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = connect(small)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, duck, name):
    frame = QUERIES[name](spark, small)
    relation = duck.sql(ORACLES[name])
    types = dict(zip(relation.columns, map(str, relation.types)))
    assert compare(frame.toPandas(), relation.df()) is None
    assert kinds(frame, types) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_every_statement_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
