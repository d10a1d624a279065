"""A curve that only rises has no drawdown to divide by."""

import datetime as dt
import math

from barloom.operators import risk
from barloom.plans import load


def test_gain_without_drawdown(spark):
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(i), v, 1.0) for s, curve in (("up", (1.0, 1.1, 1.3, 1.4)), ("flat", (1.0, 1.0, 1.0, 1.0)), ("dip", (1.0, 0.9, 1.2, 1.4))) for i, v in enumerate(curve)]
    load()
    from barloom.plans.risk import calmar

    df = risk.equity_metrics(spark.createDataFrame(rows, "strategy string, trade_date date, value double, turnover double"))
    got = {x["strategy"]: x["c"] for x in df.select("strategy", calmar().alias("c")).collect()}
    assert got["up"] == math.inf and got["flat"] == 0.0 and 0 < got["dip"] < math.inf
