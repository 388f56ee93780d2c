"""Every query that has an SQL form against it, on the whole small tables."""

from __future__ import annotations

import pytest

from compare import connect, differences
from srclens.llm import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    problems, rows, _, _ = differences(QUERIES[name](spark, SF), con, ORACLES[name])
    assert not problems
    assert rows
