"""Every named query against its SQL on the given tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from fenceline.plans import catalog, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    named = {q.__name__ for q in catalog.QUERIES}
    assert named == set(oracle.SQL)
    assert named <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["reason", "n_docs", "avg_prompt_chars"]
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [q.__name__ for q in catalog.QUERIES])
def test_query(spark, con, name):
    compare(spark, con, name, SF)
