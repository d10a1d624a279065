"""A table of parameter sets in one pass, against each set on its own."""

from pyspark.sql import functions as F

from barloom.operators import signals as S, trend
from barloom.plans.signals import TABLE


def test_a_table_of_sets_is_each_set_alone(spark, bars):
    ind = trend.indicators(bars).where("symbol < 2")
    out = ("score_base", "score", "level", "exit_score", "stop_loss", "risk_level")
    grid = S.grid(ind, TABLE)
    plan = grid._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1
    got = {(r["params"], r["symbol"], r["trade_date"]): tuple(r[c] for c in out) for r in grid.collect()}
    some = ("base", "slow_cross", "tight_stop", "far", "strict_div")
    for name in some:
        alone = S.signals(ind, TABLE[name]).select("symbol", "trade_date", *out).collect()
        assert {k[1:]: v for k, v in got.items() if k[0] == name} == {(r["symbol"], r["trade_date"]): tuple(r[c] for c in out) for r in alone}
    assert len({tuple(v for k, v in sorted(got.items()) if k[0] == name) for name in TABLE}) > 5


def test_histories_keep_columns_and_rows(spark, bars):
    df = trend.crosses(trend.macd(trend.atr(bars))).withColumn("note", F.when(F.col("i") % 2 == 0, "x")).repartition(7)
    got = S.divergence(S.golden_norm(df))
    assert got.count() == bars.count() and set(df.columns) <= set(got.columns)
    assert got.where("golden_strength is null").count() == df.where("atr is null or atr = 0").count()
    same = got.select(*df.columns).exceptAll(df)
    assert same.count() == 0
