"""The bar panel: one row per (symbol, trade_date), raw and adjusted price columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

PRICES = ("open", "high", "low", "close")

# A symbol has at most one row per trading day, so windows over these are bounded by the
# calendar (about 250 rows a year) whatever the number of ticks behind them.
def by_symbol():
    return W.partitionBy("symbol").orderBy("trade_date")


#: Bars of a partition that indicators widen to some sixty columns: about 150 MB in a sort.
DEALT_ROWS = 250_000
#: Ticks of one symbol that a task may sum up alone; more are summed up by day before they are dealt.
HOT_TICKS = 4 * DEALT_ROWS


def dealt(bars: DataFrame, rows: int) -> DataFrame:
    """Bars dealt by symbol into partitions of about DEALT_ROWS of `rows` rows.  Indicators add many columns after
    the shuffle, so its own size says too little: a partition grows with the table until its sorts spill."""
    return bars.repartition(max(-(-rows // DEALT_ROWS), bars.sparkSession.sparkContext.defaultParallelism), "symbol")


def history():
    return by_symbol().rowsBetween(W.unboundedPreceding, 0)


def tail(n: int, to: int = 0):
    """The last `n` rows of the symbol, ending `-to` rows before the current one."""
    return by_symbol().rowsBetween(to - n + 1, to)


def full(agg: Column, n: int, min_periods: int | None = None, src: str = "close", to: int = 0) -> Column:
    """`agg` over the last n rows, null until `min_periods` (default n) values exist."""
    w = tail(n, to)
    return F.when(F.count(src).over(w) >= (n if min_periods is None else min_periods), agg.over(w))


def along_history(df: DataFrame, added: T.StructType, *steps: Callable[[pa.Table], dict[str, pa.Array]]) -> DataFrame:
    """df with the columns that steps compute from each symbol's rows in order of date; a step sees those of earlier ones.

    A symbol (bounded by the calendar) is one Arrow group that keeps all its columns, so the plan below is
    run once and nothing is joined back; it is dealt by symbol already where windows came before.  Windows after it
    would shuffle its wide rows again, so what a query needs of windows comes with it."""
    schema = T.StructType([*[f for f in df.schema.fields if f.name not in added.fieldNames()], *added.fields])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(np.argsort(rows["trade_date"].cast("int32").to_numpy(), kind="stable"))
        columns = {f.name: rows[f.name] for f in schema.fields if f.name in rows.column_names}
        for step in steps:
            columns |= step(pa.table(columns))
        return pa.table({f.name: columns[f.name] for f in schema.fields})

    return df.drop(*added.fieldNames()).groupBy("symbol").applyInArrow(run, schema)


def doubles_of(rows: pa.Table, name: str) -> np.ndarray:
    """A column as doubles, NaN where null."""
    return rows[name].cast("float64").to_numpy()


def tick(x: Column) -> Column:
    """Round a price half up to the 0.01 tick."""
    return F.floor(x * 100 + 0.5) / 100


def bars_from_ticks(
    ticks: DataFrame, *more: Column, symbol: str, ts: str, seq: str, price: str, volume: str, amount: str
) -> DataFrame:
    """Daily bars from ticks.  Every buffer is a primitive, so the partial hash aggregate
    collapses a hot symbol before the shuffle.  `seq` (bigint) orders ticks within a day.
    more: what else to sum up of a day's ticks."""
    return ticks.groupBy(F.col(symbol).alias("symbol"), F.to_date(ts).alias("trade_date")).agg(
        F.min_by(price, seq).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, seq).alias("close"),
        F.sum(F.col(volume).cast("bigint")).alias("volume"),
        F.sum(F.col(amount).cast("decimal(18,2)")).cast("double").alias("amount"),
        *more,
    )


def with_adjusted(bars: DataFrame, factor: Column) -> DataFrame:
    """Add `adj_factor` and the four back-adjusted price columns."""
    out = bars.withColumn("adj_factor", factor)
    return out.withColumns({f"{p}_normal": F.col(p) * F.col("adj_factor") for p in PRICES})


def with_price_space(bars: DataFrame, space: str = "adj") -> DataFrame:
    """Prices in one space: "adj" for indicators and stops, "raw" for limits and execution."""
    if space == "raw":
        return bars.drop(*[f"{p}_normal" for p in PRICES])
    if space != "adj":
        raise ValueError(f"unknown price space {space!r}")
    return bars.withColumns({p: F.col(f"{p}_normal") for p in PRICES}).drop(*[f"{p}_normal" for p in PRICES])


def last_rows(panel: DataFrame) -> DataFrame:
    """Latest row per symbol: one aggregate, no sort."""
    cols = [c for c in panel.columns if c not in ("symbol",)]
    return panel.groupBy("symbol").agg(F.max_by(F.struct(*cols), "trade_date").alias("r")).select("symbol", "r.*")


def tail_n(panel: DataFrame, n: int) -> DataFrame:
    """Last n rows per symbol."""
    w = W.partitionBy("symbol").orderBy(F.desc("trade_date"))
    return panel.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def weekly(bars: DataFrame) -> DataFrame:
    """Calendar-week bars: last close of the week and the week's extremes."""
    return bars.groupBy("symbol", F.date_trunc("week", "trade_date").cast("date").alias("week")).agg(
        F.max_by("close", "trade_date").alias("close"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.sum("volume").alias("volume"),
        F.max("trade_date").alias("trade_date"),
    )
