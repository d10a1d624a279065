"""Incremental bar ingestion: the batch upsert as a micro-batch sink.

The original is a batch system; late rows are re-fetched and merged by key.  A stream of
ticks or bars gets the same treatment: each micro-batch replaces whole dates idempotently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.session import cut_lineage
from barloom.sources.bars import replace_dates, upsert


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the table's folder is there, in whatever file system the path names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def upsert_sink(path: str, keys=("symbol", "trade_date"), version: str | None = None):
    """`foreachBatch` function: merge the batch into the dates it touches.

    Only those partitions are read and rewritten, and a replayed batch gives the same table.
    `version` is the column that decides between rows of one key; without it, of rows with one key
    in a batch the one with the largest columns stays.  A table that can't be read is an error:
    nothing is written then."""

    def write(batch: DataFrame, _epoch: int) -> None:
        spark = batch.sparkSession
        order = F.col(version) if version else F.lit(0)
        stored = spark.read.parquet(path) if _exists(spark, path) else spark.createDataFrame([], batch.schema)
        days = batch.select("trade_date").distinct()
        touched = stored.select(*batch.columns).join(days, "trade_date", "left_semi")
        replace_dates(cut_lineage(upsert(touched, batch, keys, order)), path)

    return write


def bars_on_event_time(ticks: DataFrame, delay: str, *, symbol="symbol", ts="ts", seq="seq", price="price", volume="volume", amount="amount") -> DataFrame:
    """Daily bars of a stream of ticks, each complete once: when ticks `delay` past the day's end have come.

    A day is a window of event time, so a tick that comes late, but within the delay, enters its own day.
    The state holds one row per symbol for each day that is still open.  `n_ticks` is what makes losses
    countable (`late_ticks`).  A tick without time or symbol is in no bar."""
    t = ticks.where(F.col(ts).isNotNull() & F.col(symbol).isNotNull()).withWatermark(ts, delay)
    day = F.window(F.col(ts), "1 day").alias("day")
    bars = t.groupBy(F.col(symbol).alias("symbol"), day).agg(
        F.min_by(price, seq).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, seq).alias("close"),
        F.sum(F.col(volume).cast("bigint")).alias("volume"),
        F.sum(F.col(amount).cast("decimal(18,2)")).cast("double").alias("amount"),
        F.count(F.lit(1)).alias("n_ticks"),
    )
    return bars.select("symbol", F.to_date("day.start").alias("trade_date"), "open", "high", "low", "close", "volume", "amount", "n_ticks")


def drain(bars: DataFrame, path: str, checkpoint: str) -> int:
    """Run the stream over all that is there now, append closed days to the table at `path`, and return the
    number of batches.  Restarted with the same checkpoint it goes on where it stopped, each day still
    written once: the sink commits a batch's files together."""
    stream = bars.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    query = stream.trigger(availableNow=True).start()
    query.awaitTermination()
    return len(query.recentProgress)


def late_ticks(ticks: DataFrame, bars: DataFrame, *, symbol="symbol", ts="ts") -> DataFrame:
    """(symbol, trade_date, n_ticks, n_late): days of which ticks came after the day was closed, from the
    stored ticks and the closed bars.  A day that is still open is not listed: `bars` then ends before it."""
    closed = F.lit(bars.agg(F.max("trade_date")).scalar())
    seen = ticks.where(F.col(ts).isNotNull() & F.col(symbol).isNotNull()).groupBy(F.col(symbol).alias("symbol"), F.to_date(ts).alias("trade_date")).agg(F.count(F.lit(1)).alias("n_ticks"))
    kept = bars.select("symbol", "trade_date", F.col("n_ticks").alias("_in"))
    found = seen.where(F.col("trade_date") <= closed).join(kept, ["symbol", "trade_date"], "left")
    return found.withColumn("n_late", F.col("n_ticks") - F.coalesce("_in", F.lit(0))).where("n_late > 0").drop("_in")
