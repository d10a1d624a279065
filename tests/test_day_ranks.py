"""Ranks within a day: as pandas ranks them, in one shuffle however many factors and horizons."""

import numpy as np
import pandas as pd

from barloom.operators import research, scaling


def days(n=40, seed=5):
    rng = np.random.default_rng(seed)
    x = pd.DataFrame({"symbol": range(2 * n), "trade_date": np.repeat(pd.to_datetime(["2024-01-02", "2024-01-03"]).date, n)})
    for c in ("a", "b", "fwd_1", "fwd_5"):
        x[c] = np.round(rng.normal(size=2 * n), 1)
        x.loc[rng.random(2 * n) < 0.2, c] = np.nan
    x.loc[x["trade_date"] == x["trade_date"].iat[0], "b"] = 3.0
    return x


def frame(spark, x):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in x.itertuples(index=False)]
    return spark.createDataFrame(rows, "symbol long, trade_date date, a double, b double, fwd_1 double, fwd_5 double")


def test_rank_ic_against_pandas(spark):
    x = days()
    got = research.rank_ic(frame(spark, x), ["a", "b"], (1, 5)).toPandas().set_index(["trade_date", "factor", "lag"])
    assert len(got) == 8
    for (day, f, h), r in got.iterrows():
        y = x[x["trade_date"] == day][[f, f"fwd_{h}"]].dropna()
        want = y[f].rank().corr(y[f"fwd_{h}"].rank()) if y[f].nunique() > 1 else 0.0
        assert r["n"] == len(y) and abs(r["ic"] - want) < 1e-12


def test_percent_ranks_against_pandas(spark):
    x = days()
    got = scaling.ranks_of_day(frame(spark, x), ["symbol"], ["a", "fwd_5"]).toPandas().sort_values("symbol")
    for c in ("a", "fwd_5"):
        np.testing.assert_array_equal(got[c].to_numpy(), x.groupby("trade_date")[c].rank(pct=True).to_numpy())


def test_one_shuffle_for_all_factors_and_horizons(spark):
    df = research.rank_ic(frame(spark, days()), ["a", "b"], (1, 5))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Expand" not in plan and "Join" not in plan
