"""Every registered query against its SQL oracle."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import connect, differences
from srclens.plans import queries as registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")

QUERIES = registry.queries()
ORACLES = registry.oracle_sql()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 200


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problems, _, _, _ = differences(QUERIES[name](spark, SF), con, ORACLES[name])
    assert not problems
