"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import check_queries

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    with check_queries.connect(FOLDER) as connection:
        yield connection


@pytest.mark.parametrize("name", check_queries.entry.oracle_sql())
def test_query(spark, db, name):
    assert check_queries.compare(spark, db, FOLDER, name) == []


def test_contract(spark):
    entry = check_queries.entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["doc_id", "text"]
