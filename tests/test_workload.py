"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from check import compare, connect
from slotcast.workload import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir).toArrow()
    assert compare(got, duck.sql(ORACLES[name]).to_arrow_table()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).toArrow().num_rows > 0
