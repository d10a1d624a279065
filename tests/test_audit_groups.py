"""Audits compare features in the partitions that their windows made, and count what a join would."""

import pandas as pd
import pytest
from conftest import panel
from pyspark.sql import functions as F

from barloom.operators import integrity as I
from barloom.operators.panel import by_symbol
from barloom.plans import load
from barloom.plans.registry import Views


@pytest.mark.parametrize("name", ["i08_feature_window_closure", "i08_feature_window_leak", "i09_no_global_statistics", "i10_train_features_invariant"])
def test_wide_features_are_never_shuffled(spark, name):
    plan = load()[name].build(Views(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "SortMergeJoin" not in plan
    assert len(dealt) == 2 and all("REPARTITION_BY_NUM" in x for x in dealt)  # ticks of either side; the same, so read once


def test_counts_of_rows_that_moved(spark):
    bars = spark.createDataFrame(pd.concat([panel(2, 30), panel(1, 1).assign(symbol=5)]))
    lag = lambda df: df.withColumn("a", F.lag("close").over(by_symbol())).withColumn("b", F.col("close")).withColumn("c", F.lead("close").over(by_symbol()))
    count = lambda df: {x["feature"]: (x["n_rows"], x["n_changed"], x["passed"]) for x in df.collect()}
    # c is null on the last row and moves on the one before it
    assert count(I.check_feature_window(lag, bars, ["a", "b", "c"])) == {"a": (61, 0, True), "b": (61, 3, False), "c": (61, 2, False)}
    # with a row after it the last row gets a value where none was
    assert count(I.check_no_global_statistics(lag, bars, ["a", "b", "c"])) == {"a": (61, 0, True), "b": (61, 0, True), "c": (61, 3, False)}
    cut = str(panel(2, 30)["trade_date"][20])
    assert count(I.check_train_invariant(lag, bars, ["a", "c"], cut)) == {"a": (41, 0, True), "c": (41, 2, False)}
    assert count(I.check_train_invariant(lag, bars, ["a"], "1990-01-01")) == {"a": (0, 0, True)}
