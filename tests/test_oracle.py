"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle_check import difference, oracle_connection

from codemix.plans.oracle import ORACLE
from codemix.plans.queries import QUERIES

# Trained models have no SQL; they have tests of their own.
WITHOUT_SQL = {"logreg_eval", "forest_eval"}


@pytest.fixture(scope="module")
def connection(small):
    return oracle_connection(small)


def test_every_query_but_the_models_has_sql():
    assert set(QUERIES) - set(ORACLE) == WITHOUT_SQL
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, small, connection, name):
    assert difference(QUERIES[name](spark, small), connection.sql(ORACLE[name])) is None


def test_entry_is_the_corpus_analysis(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0].utterances > 0
