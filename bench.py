"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to a no-op sink, so the whole result is computed but not moved to Python.
Checkpoints of shared intermediates are part of the measured time."""

from __future__ import annotations

import json
import os
import time

HEADLINE = (
    "flagship_top20",
    "w03_macd",
    "w07_rsi",
    "w25_composite_score",
    "w43_ml_features",
    "x01_daily_industry_zscore",
    "x02_percent_rank",
    "x18_rank_ic",
    "j18_trade_to_bars",
    "w26_signals",
    "w52_rule_engine",
    "j05_as_of_each_row",
    "a15_fifo_lots",
    "a19_var_es",
    "c30_trade_costs",
    "w45_limit_classification",
    "q07_precheck",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from barloom.plans import load
    from barloom.plans.registry import Views
    from barloom.session import local_session

    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    reg = load()
    Views(spark, sf_dir).bars.write.format("noop").mode("overwrite").save()  # JVM warm-up
    times = {}
    for name in HEADLINE:
        t = time.time()
        reg[name].build(Views(spark, sf_dir)).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
