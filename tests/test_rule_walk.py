"""Rules from the walk along histories, against the same rules from windows and joins; and what is shuffled for them."""

import datetime as dt
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from conftest import panel
from pyspark.sql import functions as F

from barloom.operators import panel as B, rules as U, signals as S, trend
from barloom.operators.panel import tail
from barloom.plans import load
from barloom.plans.registry import Views

SF = "/root/testdata/sf0.001"


def frame(df):
    return df.toPandas().sort_values(["symbol", "trade_date"]).reset_index(drop=True)


def test_walk_agrees_with_windows(spark):
    bars = spark.createDataFrame(pd.concat([panel(2, 330, seed=4), panel(1, 3, seed=5).assign(symbol=9)]))
    at_hand = S.signals(bars)
    ch = at_hand.withColumn("_ch", F.collect_list("close").over(tail(120))).withColumns({f"cost{q}": F.percentile("close", F.lit(q / 100)).over(tail(120)) for q in (5, 50, 95)})
    ch = ch.withColumn("winner", 100.0 * F.size(F.filter("_ch", lambda x: x < F.col("close"))) / F.size("_ch"))
    want = frame(U.rule_panel(trend.vol_regime(trend.kdj(ch))))
    walked = S.signals(bars, fields=[*U.SINCE.fields, *U.CHIPS.fields, *U.RULE_ROWS.fields], steps=(U.since_rows, U.chip_rows, U.rule_rows))
    got = frame(U.rule_panel(trend.vol_regime(walked)))
    for c in [*U.CHIPS.fieldNames(), *U.SINCE.fieldNames(), *U.RULE_ROWS.fieldNames(), "aligned", "vol_regime", "atr_ratio"]:
        if c == "_atr30":
            continue
        if got[c].dtype == object:
            assert got[c].fillna("").tolist() == want[c].fillna("").tolist(), c
        else:
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-12, err_msg=c)


def test_weeks_and_forecasts_agree_with_joins(spark):
    load()
    from barloom.plans.rules import forecasts

    bars = panel(3, 200, seed=6).sample(frac=0.6, random_state=1)
    bars["sold"] = np.where(np.random.default_rng(3).random(len(bars)) < 0.5, bars["volume"], np.nan)
    exact = pd.DataFrame({"symbol": 7, "trade_date": [dt.date(2020, 1, 6), dt.date(2020, 1, 7), dt.date(2020, 2, 3)], "open": 1.0, "high": 1.0, "low": 1.0, "close": 1.0, "volume": [7, 13, 1], "amount": 1.0, "sold": [7.0, np.nan, np.nan]})
    df = spark.createDataFrame(pd.concat([bars, exact])).withColumn("sold", F.when(~F.isnan("sold"), F.col("sold")))
    got = frame(B.along_history(df.select("symbol", "trade_date", "close", "volume", "sold"), U.T.StructType([*U.WEEK.fields, *U.FORECAST.fields]), U.week_rows, U.forecast_rows))
    w = trend.macd(B.weekly(df)).select("symbol", "week", F.lag(F.col("dif") > F.col("dea")).over(B.by_symbol()).alias("b"))
    sold = df.select("symbol", "trade_date", F.when(F.col("sold").isNull(), "buy").otherwise("sell").alias("action"), F.col("volume").alias("qty"))
    told = forecasts(SimpleNamespace(trades=sold))
    want = df.withColumn("week", F.date_trunc("week", "trade_date").cast("date")).join(w, ["symbol", "week"], "left").withColumn("month", F.trunc("trade_date", "month").cast("date"))
    want = frame(want.join(told.withColumn("month", F.col("month").cast("date")), ["symbol", "month"], "left"))
    assert got["week_bull"].fillna("").tolist() == want["b"].fillna("").tolist()
    assert got["has_forecast"].tolist() == want["has_forecast"].notna().tolist()
    assert got["has_forecast"].any() and not got["has_forecast"][got["symbol"] == 7].any()


@pytest.mark.parametrize("name", ["w51_rule_predicates", "w52_rule_engine", "w53_daily_score", "w53_gated_score", "w54_chip_risk"])
def test_wide_rows_are_never_shuffled(spark, name):
    """A window or a join above the walk deals rows of some hundred columns again."""
    plan = load()[name].build(Views(spark, SF))._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("FlatMapGroupsInArrow")
    assert "Window" not in above and "SortMergeJoin" not in above and "hashpartitioning" not in above.partition("BroadcastExchange")[0]
    assert below.count("FlatMapGroupsInArrow") == 0
    bars = below.partition("BroadcastExchange")[0]
    assert bars.count("hashpartitioning(symbol") == 1  # ticks are dealt once, for bars and for histories


def test_a_hot_symbol_is_summed_up_before_it_is_dealt(spark, monkeypatch):
    cool = Views(spark, SF)
    want = [frame(x) for x in (cool.histories, cool.flows)]
    monkeypatch.setattr(B, "HOT_TICKS", 1)
    hot = Views(spark, SF)
    plan = hot.histories._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(symbol") == 2 and plan.count("HashAggregate") == 2
    assert plan.index("HashAggregate") < plan.rindex("hashpartitioning(symbol") < plan.rindex("HashAggregate")  # partly summed up below the shuffle by day
    for got, before in zip((hot.histories, hot.flows), want):
        pd.testing.assert_frame_equal(frame(got), before)
