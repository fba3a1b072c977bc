"""Every registered query against its SQL, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    assert difference(spark, duck, SMALL, name, entry.queries()[name], entry.oracle_sql().get(name)) is None


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["generator"] for r in rows} == {"conversations", "qa_pairs", "embeddings", "summaries"}
