"""Scores from one walk along a history, against the same scores from windows; and what is shuffled for them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import signals as S, trend
from barloom.operators.panel import along_history


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(5)
    rows = []
    for symbol, n in ((1, 1), (2, 4), (3, 29), (4, 1300), (5, 60)):
        close = 100 + np.cumsum(rng.normal(size=n)) if symbol != 5 else np.full(n, 50.0)
        open_ = close + rng.normal(size=n) * (symbol != 5)
        for k, day in enumerate(pd.bdate_range("2019-01-01", periods=n).date):
            hi, lo = max(open_[k], close[k]) + (symbol != 5), min(open_[k], close[k]) - (symbol != 5)
            rows.append((symbol, day, float(open_[k]), float(hi), float(lo), float(close[k]), int(rng.integers(1, 50)), float(close[k] * 7)))
    return spark.createDataFrame(rows, "symbol long, trade_date date, open double, high double, low double, close double, volume long, amount double").repartition(3, "trade_date")


def rows(df, cols):
    return df.select("symbol", "trade_date", *cols).toPandas().sort_values(["symbol", "trade_date"]).reset_index(drop=True)


def test_walk_agrees_with_windows(bars):
    w = trend.adx(trend.rsi(trend.atr(trend.turnover_columns(trend.cci(trend.stochastic(trend.bollinger(trend.crosses(trend.macd(trend.sma(bars))))))))))
    numbers = [f"ma_{p}" for p in trend.MA_PERIODS] + "bb_up bb_width amount_ma20 atr rsi adx cci slow_k slow_d dif dea macd_hist".split()
    got, want = rows(along_history(bars, trend.INDICATORS, trend.indicator_rows), numbers), rows(w, numbers)
    moving = got["symbol"] != 5  # of prices that never move the last bit of a mean decides
    for c in numbers:
        np.testing.assert_allclose(got[c][moving].astype(float), want[c][moving].astype(float), rtol=1e-6, atol=1e-9, err_msg=c)
    scores = "regime momentum_score slope_score volume_price_score candle_score golden_score exit_score".split()
    w = w.withColumn("macd_trend", S.macd_trend(F.col("dif"), F.col("dea")))
    w = S.candle_score(S.volume_price_score(S.slope_score(S.momentum_score(S.regime(w)))))
    w = S.exit_score(S.risk_level(S.golden_score(S.golden_norm(S.last_stop(S.oldest_cross(S.divergence(w)))))))
    got, want = rows(S.signals(bars), scores)[moving], rows(w, scores)[moving]
    for c in scores:
        assert (got[c] == want[c]).mean() > 0.999, c


def test_bars_are_sorted_and_shuffled_once(bars):
    plan = S.signals(bars.repartition(4, "symbol"))._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("== Initial Plan ==") :] if "== Initial Plan ==" in plan else plan
    assert plan.count("FlatMapGroupsInArrow") == 1
    assert "Window" not in plan
    assert plan.count("Sort [") == 1
