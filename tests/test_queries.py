"""Every registered query against its SQL on the smallest tables."""

import pytest
from check_queries import compare, entry, oracle_connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    ok, text = compare(spark, con, SF, name)
    assert ok, text


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
