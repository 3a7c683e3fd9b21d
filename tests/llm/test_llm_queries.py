"""Registered queries of the subpackage against their SQL."""

import pytest
from compare import compare, connect

from codeloom.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, con, key):
    assert compare(spark, con, QUERIES[key], ORACLES[key], FOLDER) == []


def test_all_are_registered():
    import __spark_entry__ as e

    assert {*QUERIES, "pipeline"} <= set(e.queries())
    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 14))
