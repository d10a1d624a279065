"""Moving averages whose window depends on the symbol's length, against pandas."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators.quality import degraded_means


@pytest.mark.parametrize("mode", ["RELAX", "SKIP", "STRICT"])
def test_degraded_means(spark, mode):
    rng = np.random.default_rng(1)
    rows = [(s, d, float(x)) for s, n in enumerate((1, 2, 7, 30, 90)) for d, x in zip(pd.bdate_range("2024-01-01", periods=n).date, rng.uniform(5, 20, n))]
    periods, least = (1, 5, 20, 60), 3
    found = degraded_means(spark.createDataFrame(rows, "symbol long, trade_date date, close double"), periods, mode, least)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    got = found.toPandas().sort_values(["symbol", "trade_date"]).set_index("symbol")
    for s, d in pd.DataFrame(rows, columns=["symbol", "day", "close"]).groupby("symbol"):
        n, low = len(d), np.zeros(len(d), bool)
        for p in periods:
            short = n < p
            used = max(1, min(p, max(least, n // 2))) if short and mode == "RELAX" else p
            want = d["close"].rolling(used).mean().to_numpy()
            assert got.loc[[s], f"ma_{p}"].to_numpy(float) == pytest.approx(want, nan_ok=True)
            low |= short & ((np.arange(1, n + 1) >= used) if mode == "RELAX" else np.full(n, mode == "SKIP"))
        assert (got.loc[[s], "low_confidence"].to_numpy() == low).all()
