"""Registered queries at the smallest scale against their SQL counterparts.

By default all families but grids, trajectories and models, which have tests of their own; with
``HAZEGRID_ALL_QUERIES=1`` every query. ``tests/oracle_check.py`` does the same at any scale.
"""

import os

import pytest
from oracle_check import duck, frames_equal

import __spark_entry__ as contract
from hazegrid.plans import catalogue

SF = "/root/testdata/sf0.001"
FAMILIES = ("aq_", "px_", "ex_", "snk_", "src_", "jn_", "tm_", "qa_", "fe_", "hs_", "ts_", "flagship")
EVERYTHING = os.environ.get("HAZEGRID_ALL_QUERIES") == "1"


def chosen(names):
    return sorted(n for n in names if EVERYTHING or n.startswith(FAMILIES))


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", chosen(catalogue.ORACLES))
def test_query_equals_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = con.execute(catalogue.ORACLES[name]).df()
    assert (problem := frames_equal(got, want)) is None, problem


@pytest.mark.parametrize("name", chosen(set(catalogue.QUERIES) - set(catalogue.ORACLES)) if EVERYTHING else [])
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_prune_columns_push_filters_and_stay_lean(spark):
    flagship = _plan(catalogue.QUERIES["flagship_station_index"](spark, SF))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in flagship
    assert flagship.count("Exchange hashpartitioning") == 2  # instants, then station-days
    assert "CartesianProduct" not in flagship and "BroadcastNestedLoopJoin" not in flagship
    fires = _plan(catalogue.QUERIES["qa_06_strong_fires"](spark, SF))
    assert "EqualTo(event_type,purchase)" in fires and "GreaterThan(value,20.0)" in fires and "Exchange" not in fires
    fused = _plan(catalogue.QUERIES["jn_07_point_in_box"](spark, SF))
    assert "Join" not in fused and "Exchange" not in fused
    for name in ("gr_08_neighbourhood", "jn_03_points_to_stations", "ml_10_krige_residuals", "tr_02_wind_rose"):
        plan = _plan(catalogue.QUERIES[name](spark, SF))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
