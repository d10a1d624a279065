"""A spread of registered queries against DuckDB, and plan checks.

The whole registry is compared by `python tests/oracle.py 0.01`."""

import pytest
from oracle import compare, connect

from barloom.plans import load
from barloom.plans.registry import Views

SF = "/root/testdata/sf0.001"
SOME = (
    "flagship_top20 w04_macd_crosses w14_regime x02_percent_rank x16_factor_fusion x21_decile_summary j05_as_of_each_row j09_status_intervals "
    "a13_equity_metrics a15_fifo_lots a20_brinson c30_trade_costs w45_limit_classification q07_precheck i02_feature_leakage m02_walk_forward_folds s05_incremental_merge"
).split()


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(SF), name, load()[name], SF).startswith("ok")


def test_every_query_has_a_contract():
    reg = load()
    assert len(reg) > 200
    without = sorted(n for n, q in reg.items() if q.sql is None)
    assert len(without) < 20, without


@pytest.mark.parametrize("name", ["w25_composite_score", "a15_fifo_lots", "x18_rank_ic", "j19_missing_days", "w52_rule_engine"])
def test_plans_have_no_cartesian_product(spark, name):
    df = load()[name].build(Views(spark, SF))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_filter_and_columns_reach_the_scan(spark):
    df = Views(spark, SF).table("lineitem").where("l_shipdate >= '2001-01-01'").select("l_suppkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    assert "ReadSchema: struct<l_suppkey:bigint,l_shipdate" in plan
