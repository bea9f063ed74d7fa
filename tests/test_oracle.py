"""Every query with a fixed result agrees with its DuckDB text."""

import pytest
from check_oracle import compare, duck

from bindings import load

QUERIES, ORACLES = load()


@pytest.fixture(scope="session")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), ORACLES[name], con) is None


def test_every_text_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
