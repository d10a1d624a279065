import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from barloom.session import local_session

    s = local_session(4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def panel(symbols=3, days=130, seed=42):
    rng = np.random.default_rng(seed)
    out = []
    for s in range(symbols):
        c = 10 + np.cumsum(rng.normal(0, 0.3, days)).clip(-7)
        o = c + rng.normal(0, 0.1, days)
        out.append(
            pd.DataFrame(
                {
                    "symbol": s,
                    "trade_date": pd.bdate_range("2020-01-01", periods=days).date,
                    "open": o,
                    "high": np.maximum(o, c) + rng.random(days) * 0.2,
                    "low": np.minimum(o, c) - rng.random(days) * 0.2,
                    "close": c,
                    "volume": rng.integers(100, 1000, days),
                    "amount": c * 1000,
                    "adj_factor": 1.0,
                }
            )
        )
    return pd.concat(out, ignore_index=True)


@pytest.fixture(scope="session")
def bars(spark):
    return spark.createDataFrame(panel())
