"""Every registered query against the SQL that defines it."""

import time

import pytest

import check
from __spark_entry__ import entry
from driftwell.plans import registry

registry.load_all()
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="module")
def con(sf):
    return check.connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    verdict, _, _ = check.compare(df, con, ORACLES[name], time.time())
    assert verdict == "ok"
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "PythonUDF"):
        assert node not in plan


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["round_id", "term", "n"] and df.count() > 0
