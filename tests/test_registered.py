"""Every registered query against its SQL answer, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

QUERIES = {name: query for name, query in entry.queries().items() if name in entry.REGISTERED}
ANSWERS = {name: sql for name, sql in entry.oracle_sql().items() if name in entry.REGISTERED}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_answer():
    assert set(QUERIES) == set(ANSWERS)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {r.status for r in rows} <= {200, 400, 401, 422, 429}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, QUERIES[name], ANSWERS.get(name)) is None
