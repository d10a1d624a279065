"""Bars of a stream on event time: late ticks, ticks beyond the watermark, a restart."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from barloom.operators.panel import bars_from_ticks
from barloom.streaming.bars import bars_on_event_time, drain, late_ticks

SCHEMA = "symbol long, ts timestamp, seq long, price double, volume long, amount double"


def day(n, hour=10):
    return datetime(2024, 1, 1) + timedelta(days=n, hours=hour)


def ticks(spark, rows):
    return spark.createDataFrame([(s, ts, q, 10.0 + q % 7, q, 1.5 * q) for s, ts, q in rows], SCHEMA)


def deliver(spark, folder, rows):
    raw, out, state = (f"{folder}/{x}" for x in ("raw", "bars", "state"))
    ticks(spark, rows).write.mode("append").parquet(raw)
    drain(bars_on_event_time(spark.readStream.schema(SCHEMA).parquet(raw), "2 days"), out, state)
    return spark.read.schema(SCHEMA).parquet(raw), spark.read.parquet(out)


def test_late_ticks_enter_their_day_and_lost_ones_are_counted(spark, tmp_path):
    first = [(s, day(d, h), 100 * d + 10 * s + h) for s in (1, 2) for d in range(6) for h in (9, 11, 15)]
    deliver(spark, tmp_path, first)
    # the watermark is day 5, 15:00, less two days: the window of day 4 is open, that of day 0 is closed
    late, lost = [(1, day(4, 8), 1), (2, day(5, 8), 2), (3, day(4, 8), 3)], [(1, day(0, 8), 4), (1, day(0, 9), 5), (4, day(1), 6)]
    deliver(spark, tmp_path, late + lost)
    raw, bars = deliver(spark, tmp_path, [(9, day(40), 0), (None, day(2), 7), (1, None, 8)])
    want = bars_from_ticks(ticks(spark, first + late), symbol="symbol", ts="ts", seq="seq", price="price", volume="volume", amount="amount")
    got = bars.drop("n_ticks")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    missing = {(r["symbol"], r["trade_date"].day - 1): (r["n_ticks"], r["n_late"]) for r in late_ticks(raw, bars).collect()}
    assert missing == {(1, 0): (5, 2), (4, 1): (1, 1)}
    assert bars.groupBy("symbol", "trade_date").count().where(F.col("count") > 1).count() == 0


def test_nothing_new_changes_nothing(spark, tmp_path):
    rows = [(1, day(d), d) for d in range(9)]
    _, before = deliver(spark, tmp_path, rows)
    closed = before.count()
    _, after = deliver(spark, tmp_path, [])
    assert 0 < closed == after.count() < 9
