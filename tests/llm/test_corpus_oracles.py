"""The corpus queries with a DuckDB text agree with it."""

import pytest
from check_oracle import compare, duck

from riskloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), ORACLES[name], duck(sf_dir)) is None


def test_thirteen_operators():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
