"""Every registered query against its SQL, on the smallest given tables."""

import os

import compare
import pytest

import __spark_entry__ as entry

FOLDER = entry.SMOKE_DIR

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    ours = entry.queries()[name](spark, FOLDER).toPandas()
    assert len(ours) > 0
    if name in entry.oracle_sql():
        assert compare.difference(ours, duck.sql(entry.oracle_sql()[name]).df()) is None


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "bigram_logprob"]
