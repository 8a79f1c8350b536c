"""Queries with SQL against DuckDB, and the shape of all registered queries."""

import pytest

import __spark_entry__ as entry
from riskloom.llm.oracles import ORACLES
from riskloom.llm.queries import QUERIES
from tests.conftest import SF_SMALL
from tools.oracle_check import compare, duck


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, name):
    r = compare(spark, duck(SF_SMALL), name, QUERIES[name], ORACLES[name], SF_SMALL)
    assert r["status"] == "MATCH", r


def test_all_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == {*range(1, 14)}
    assert {*QUERIES, "pipeline"} <= names and set(ORACLES) <= set(entry.oracle_sql())
