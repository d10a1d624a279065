"""Bar sources, assembly, incremental merge and sinks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def scan(bars: DataFrame, symbols: DataFrame | Sequence | None = None, start: str | None = None, end: str | None = None, replay: str | None = None) -> DataFrame:
    """Bars of a symbol set and date range; `replay` clamps the end for point-in-time runs.
    Dates and short symbol lists reach the scan; a symbol table is a semi join."""
    if replay is not None:
        end = replay if end is None else min(end, replay)
    if start:
        bars = bars.where(F.col("trade_date") >= F.lit(start).cast("date"))
    if end:
        bars = bars.where(F.col("trade_date") <= F.lit(end).cast("date"))
    if isinstance(symbols, DataFrame):
        return bars.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    return bars if symbols is None else bars.where(F.col("symbol").isin(list(symbols)))


def read_jdbc(spark: SparkSession, url: str, table: str, partition: str, low: str, high: str, parts: int, **options) -> DataFrame:
    """Partitioned database read; filters on the result are pushed to the database."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=partition, lowerBound=low, upperBound=high, numPartitions=parts, **options
    ).load()


PRICES = ("open", "high", "low", "close")


def assemble_from_factor(raw: DataFrame, factors: DataFrame, lot: float = 100, amount_unit: float = 10_000) -> DataFrame:
    """Raw bars times the factor of the day; rows without a positive factor and close go."""
    j = raw.join(factors, ["symbol", "trade_date"]).where((F.col("adj_factor") > 0) & (F.col("close") > 0))
    j = j.withColumns({f"{p}_normal": F.col(p) * F.col("adj_factor") for p in PRICES})
    return j.withColumn("volume", (F.col("volume") * lot).cast("bigint")).withColumn("amount", F.col("amount") * amount_unit)


def assemble_from_adjusted(raw: DataFrame, adjusted: DataFrame) -> DataFrame:
    """Raw bars with an adjusted series: the factor is their ratio, 1 where it is missing."""
    a = adjusted.select("symbol", "trade_date", F.col("close").alias("close_normal"))
    j = raw.join(a, ["symbol", "trade_date"], "left")
    f = F.coalesce(F.try_divide(F.col("close_normal"), F.col("close")), F.lit(1.0))
    return j.withColumn("adj_factor", f).withColumn("close_normal", F.coalesce("close_normal", F.col("close")))


def classify_update(stored: DataFrame, incoming: DataFrame, tol: float = 1e-4, moved: float = 0.005) -> DataFrame:
    """append / restate per symbol: restate when the factor at the last stored date or an
    adjusted close in the overlap changed."""
    last = stored.groupBy("symbol").agg(F.max("trade_date").alias("_z"), F.max_by("adj_factor", "trade_date").alias("_f"))
    s = stored.select("symbol", "trade_date", F.col("close_normal").alias("_c"))
    j = incoming.join(last, "symbol", "left").join(s, ["symbol", "trade_date"], "left")
    at_last = (F.col("trade_date") == F.col("_z")) & (F.abs(F.try_divide(F.col("adj_factor"), F.col("_f")) - 1) > tol)
    shifted = F.abs(F.try_divide(F.col("close_normal"), F.col("_c")) - 1) > moved
    return j.groupBy("symbol").agg(
        F.when(F.max(F.coalesce(at_last | shifted, F.lit(False))), "restate").otherwise("append").alias("mode"), F.max("_z").alias("latest")
    )


def merge_update(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """New table: restated symbols from the feed, others plus rows after their latest date.

    Only restated symbols are rewritten, the rest of the history is kept as it is."""
    mode = classify_update(stored, incoming)
    keep = stored.join(mode.where("mode = 'restate'"), "symbol", "left_anti")
    new = incoming.join(mode, "symbol").where((F.col("mode") == "restate") | F.col("latest").isNull() | (F.col("trade_date") > F.col("latest")))
    return keep.unionByName(new.select(*stored.columns))


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], version: Column) -> DataFrame:
    """Idempotent upsert, the row of the highest version per key wins, whatever its values; applying
    it twice changes nothing.  Rows equal in key and version are told apart by their columns."""
    keys = list(keys)
    rest = [c for c in incoming.columns if c not in keys]
    new = incoming.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, *rest)).alias("_s")).select(*keys, "_s.*")
    return stored.join(new, keys, "left_anti").unionByName(new.select(*stored.columns))


def replace_dates(df: DataFrame, path: str, date: str = "trade_date") -> None:
    """Delete-then-insert of the dates present in `df`: dynamic partition overwrite."""
    df.repartition(date).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def truncate_insert(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def detect_semantics(bars: DataFrame) -> DataFrame:
    """One row: swap / fill / ok / undecided from two conditional counts over rows with a
    factor other than 1."""
    f = F.col("adj_factor")
    near = lambda x, y: F.abs(F.try_divide(x, y) - 1) < 0.01
    d = bars.where(F.abs(f - 1) > 1e-6).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(near(F.col("close_normal"), F.col("close") * f), 1)).alias("n_contract"),
        F.count(F.when(near(F.col("close"), F.col("close_normal") * f), 1)).alias("n_swapped"),
        F.count(F.when(F.col("close_normal").isNull(), 1)).alias("n_missing"),
    )
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n")), F.lit(0.0))
    return d.withColumn(
        "action",
        F.when((share("n_swapped") >= 0.8) & (share("n_contract") < 0.2), "swap").when(F.col("n_missing") > 0, "fill").when(share("n_contract") >= 0.8, "ok").otherwise("undecided"),
    )


def repair_semantics(bars: DataFrame) -> DataFrame:
    action = detect_semantics(bars).select("action").scalar()
    cols = {}
    for p in PRICES:
        a, b = F.col(p), F.col(f"{p}_normal")
        cols[p] = F.when(action == "swap", b).otherwise(a)
        cols[f"{p}_normal"] = F.when(action == "swap", a).when((action == "fill") & b.isNull(), a * F.col("adj_factor")).otherwise(b)
    return bars.withColumns(cols)


def archive_lists(lists: dict[str, DataFrame], day: str) -> DataFrame:
    """Tagged union of strategy lists, one row per code within each list."""
    parts = [d.select("symbol").distinct().withColumn("strategy", F.lit(k)) for k, d in lists.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("archive_date", F.lit(day).cast("date"))


def probes(df: DataFrame, date: str = "trade_date", key: str = "symbol") -> DataFrame:
    return df.agg(F.max(date).alias("latest"), F.count_distinct(key).alias("n_keys"), F.count(F.lit(1)).alias("n_rows"))


def stale(bars: DataFrame, pool: DataFrame, as_of: str) -> DataFrame:
    """Pool symbols without a bar on the date, with their latest one (null if none)."""
    last = bars.groupBy("symbol").agg(F.max("trade_date").alias("latest"))
    return pool.select("symbol").distinct().join(last, "symbol", "left").where(F.col("latest").isNull() | (F.col("latest") < F.lit(as_of).cast("date")))


def not_special(df: DataFrame, name: str = "name") -> DataFrame:
    return df.where(~F.coalesce(F.col(name).rlike(r"(?i)ST|退"), F.lit(False)))


def main_board(df: DataFrame, code: str = "code", prefixes: Sequence[str] = ("600", "601", "603", "605", "000", "001", "002", "003")) -> DataFrame:
    return df.where(F.substring(code, 1, 3).isin(*prefixes))


def covered(df: DataFrame, reports: DataFrame, at_least: int, key: str = "symbol") -> DataFrame:
    """Rows whose key has at least k research reports."""
    ok = reports.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= at_least)
    return df.join(ok, key, "left_semi")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def merge_report(manifest: DataFrame) -> DataFrame:
    """Success rate per run from (run, part, status)."""
    return manifest.groupBy("run").agg(F.count(F.lit(1)).alias("parts"), F.avg((F.col("status") == "ok").cast("double")).alias("success_rate"))
