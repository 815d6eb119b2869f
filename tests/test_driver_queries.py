"""Every driver query against its SQL check, and the contract of the entry module."""

import pytest

import __spark_entry__ as contract
from tools.compare import connect, difference


@pytest.fixture(scope="module")
def db(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.TRAINING_QUERIES)))
def test_query_equals_its_sql(spark, db, folder, name):
    problem, rows = difference(spark, db, name, folder)
    assert problem == ""
    assert rows > 0


def test_every_check_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(contract.queries()) - set(contract.oracle_sql()) - set(contract.TRAINING_QUERIES) == {"fuzzy_search"}


def test_entry_gives_rows(spark):
    result = contract.entry(spark)
    assert result.columns == ["query_id", "rank", "key", "score"]
    assert result.count() > 0
