"""Ranks do not depend on how finely values are binned."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators import scaling


@pytest.mark.parametrize("rows_in_a_bin", [1, 50, 1 << 20])
def test_ranks_for_any_number_of_bins(spark, monkeypatch, rows_in_a_bin):
    monkeypatch.setattr(scaling, "BIN_ROWS", rows_in_a_bin)
    rng = np.random.default_rng(3)
    x = pd.DataFrame({"g": rng.integers(0, 3, 600), "x": np.round(rng.normal(size=600) * 10.0 ** rng.integers(-3, 4, 600), 2), "s": [f"{'prefix' * 3}{k:03d}" for k in rng.integers(0, 90, 600)], "i": range(600)})
    df = scaling.with_ranks(spark.createDataFrame(x), ["g"], {"a": "x", "b": "s"})
    got = df.select("i", scaling.avg_rank("a").alias("a"), scaling.avg_rank("b").alias("b")).toPandas().sort_values("i")
    assert (got["a"].to_numpy() == x.groupby("g")["x"].rank().to_numpy()).all()
    assert (got["b"].to_numpy() == x.groupby("g")["s"].rank().to_numpy()).all()


def test_more_rows_more_bins():
    assert [scaling.bins_for(n) for n in (0, 10**6, 10**7, 10**9, 10**15)] == [4, 4, 16, 1024, 1 << 20]
