"""Skew-safe building blocks: group statistics, ranks, quantiles and running totals.

None of them puts a whole group into one task.  A group is first reduced with map-side
aggregation, then split into blocks; only small per-block tables are windowed per group.
Everything is exact and deterministic, so a recomputed partition gives the same answer.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from barloom.session import cut_lineage


def group_stats(df: DataFrame, by: Sequence[str], *aggs: Column) -> DataFrame:
    """Attach per-group aggregates: partial aggregation plus join, not an unbounded window.

    AQE broadcasts the statistics when they turn out small and splits a hot key otherwise."""
    return df.join(df.groupBy(*by).agg(*aggs), list(by), "left")


def totals(df: DataFrame, *aggs: Column) -> Column:
    """Whole-table aggregates as one scalar struct (no cross join)."""
    return df.agg(F.struct(*aggs).alias("t")).scalar()


def beside(df: DataFrame, *singles: DataFrame) -> DataFrame:
    """Attach the columns of one-row frames as scalar subqueries (no cross join)."""
    for one in singles:
        t = one.select(F.struct(*one.columns).alias("t")).scalar()
        df = df.withColumns({c: t.getField(c) for c in one.columns})
    return df


#: Bins for each e-fold of size where the number of rows is not known, and rows of a bin where it is.
FINE, BIN_ROWS = 4096, 1 << 20


def bins_for(n_rows: int) -> int:
    """Bins for each e-fold of size that leave about BIN_ROWS rows in one, if all rows were a group within one
    e-fold: few for small tables, where bins cost more than they save, and more as the table grows."""
    return min(1 << 20, max(4, 1 << math.ceil(math.log2(max(1, n_rows / BIN_ROWS)))))


def value_bin(df: DataFrame, value: str, fine: int = FINE) -> Column:
    """A monotone map of values to a bounded set of bins that needs no statistics.

    Java's log is semi-monotonic, so equal or larger values never fall into a lower bin; `fine` bins
    cover each e-fold, from the least to the largest double, on either side of zero.  Text is binned by
    its first characters, more of them as `fine` grows."""
    if dict(df.dtypes)[value] == "string":
        return F.substring(value, 1, 8 if fine < FINE else 32)
    x = F.col(value).cast("double")
    size = F.least(F.log(F.abs(x)), F.lit(710.0)) + 746  # positive for every double but zero
    return F.coalesce(F.signum(x) * F.floor(size * fine), F.lit(0)).cast("long")


def value_counts(df: DataFrame, by: Sequence[str], value: str, fine: int = FINE) -> DataFrame:
    """Distinct non-null values per group with `cnt`, `below` (rows under it) and `total`.

    Running counts inside a bin plus the offset of the bin give the exact running count, so
    no task sorts more than one bin of a group, and equal values are one row.  NaN counts as null."""
    by = list(by)
    if not by:
        return value_counts(df.select(F.lit(1).alias("_all"), value), ["_all"], value, fine).drop("_all")
    here = F.col(value).isNotNull()
    if dict(df.dtypes)[value] in ("double", "float"):
        here &= ~F.isnan(value)  # as missing as null
    d = df.where(here).groupBy(*by, value).agg(F.count(F.lit(1)).alias("cnt"))
    d = d.withColumn("_bin", value_bin(df, value, fine))
    group = W.partitionBy(*by)
    offs = d.groupBy(*by, "_bin").agg(F.sum("cnt").alias("_c")).select(
        *by,
        "_bin",
        F.coalesce(F.sum("_c").over(group.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_c").over(group).alias("total"),
    )
    inner = W.partitionBy(*by, "_bin").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return (
        d.withColumn("_cum", F.sum("cnt").over(inner))
        .join(offs, [*by, "_bin"])
        .withColumn("below", F.col("_off") + F.col("_cum") - F.col("cnt"))
        .drop("_bin", "_off", "_cum")
    )


def reuse(df: DataFrame) -> DataFrame:
    """Materialise an intermediate that several branches of one plan read.

    A reliable checkpoint in the shared folder: computed once, kept on executor loss, and the
    plan above it starts from a scan instead of repeating the whole lineage per branch."""
    return cut_lineage(df)


def with_ranks(df: DataFrame, by: Sequence[str], values: dict[str, str]) -> DataFrame:
    """Rank several columns within the same groups: for each {prefix: column} add
    `<prefix>_below`, `<prefix>_ties`, `<prefix>_total` (nulls for null values)."""
    by = list(by)
    df = reuse(df)
    fine, out = bins_for(df.count()), df
    for prefix, value in values.items():
        keys = list(dict.fromkeys([*by, value]))
        vc = value_counts(df.select(*keys), by, value, fine).select(
            *keys,
            F.col("below").alias(f"{prefix}_below"),
            F.col("cnt").alias(f"{prefix}_ties"),
            F.col("total").alias(f"{prefix}_total"),
        )
        out = out.join(vc, keys, "left")
    return out


def with_rank(df: DataFrame, by: Sequence[str], value: str, prefix: str = "rk") -> DataFrame:
    return with_ranks(df, by, {prefix: value})


def avg_rank(prefix: str = "rk") -> Column:
    """Average rank (1-based) of tied values."""
    return F.col(f"{prefix}_below") + (F.col(f"{prefix}_ties") + 1) / 2.0


def pct_rank(prefix: str = "rk") -> Column:
    """Average rank over the number of ranked rows."""
    return avg_rank(prefix) / F.col(f"{prefix}_total")


def doubles(rows: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Columns of an Arrow table side by side; NaN where null."""
    return np.column_stack([rows[c].to_numpy() for c in names]).astype("float64", copy=False)


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Average-tie ranks from 1 of numbers without NaN."""
    order = np.argsort(x, kind="stable")
    ordered = x[order]
    start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    size = np.diff(np.r_[start, len(x)])
    out = np.empty(len(x))
    out[order] = np.repeat(start + (size + 1) / 2.0, size)
    return out


def ranks_of_day(df: DataFrame, keys: Sequence[str], cols: Sequence[str], day: str = "trade_date") -> DataFrame:
    """(keys, cols): percent ranks with average ties of each column within the day; nulls and NaN stay null.

    For many columns of the same rows: a day has one row a name, is one Arrow group and is shuffled once, wide.
    Groups that grow with the table take `with_ranks`."""
    schema = T.StructType([*[df.schema[k] for k in keys], *[T.StructField(c, T.DoubleType()) for c in cols]])

    def run(rows: pa.Table) -> pa.Table:
        out = {k: rows[k] for k in keys}
        for c in cols:
            (x,) = doubles(rows, [c]).T
            there = ~np.isnan(x)
            p = np.full(len(x), np.nan)
            p[there] = average_ranks(x[there]) / max(1, there.sum())
            out[c] = pa.array(p, mask=~there)
        return pa.table(out)

    return df.select(*keys, F.col(day).alias("_day"), *[F.col(c).cast("double").alias(c) for c in cols]).groupBy("_day").applyInArrow(run, schema)


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation as an aggregate; null where one side does not vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def quantiles(df: DataFrame, by: Sequence[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group as columns, from running counts."""
    vc = value_counts(df, by, value)
    aggs = []
    for name, q in qs.items():
        h = (F.col("total") - 1) * F.lit(float(q))
        lo, hi = F.floor(h), F.ceil(h)
        holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("cnt"))
        aggs += [
            F.max(F.when(holds(lo), F.col(value))).alias(f"_{name}_lo"),
            F.max(F.when(holds(hi), F.col(value))).alias(f"_{name}_hi"),
            F.max(h - lo).alias(f"_{name}_f"),
        ]
    out = vc.groupBy(*by).agg(*aggs)
    return out.select(
        *by,
        *[
            (F.col(f"_{n}_lo") + F.col(f"_{n}_f") * (F.col(f"_{n}_hi") - F.col(f"_{n}_lo"))).alias(n)
            for n in qs
        ],
    )


def running_sums(
    df: DataFrame, key: Sequence[str], block: Sequence[str], order: Sequence[str], sums: dict[str, str]
) -> DataFrame:
    """Inclusive running sums per key, `sums` = {output: input column}.

    `block` columns lead the order, so a hot key is split by block; the per-block totals are
    the only rows windowed per key.  `<out>_min` carries the running minimum, floored at 0."""
    key, block = list(key), list(block)
    inner = W.partitionBy(*key, *block).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    loc = df
    for out, col in sums.items():
        loc = loc.withColumn(f"_l_{out}", F.sum(col).over(inner))
    for out in sums:
        loc = loc.withColumn(f"_m_{out}", F.min(f"_l_{out}").over(inner))
    tot = loc.groupBy(*key, *block).agg(
        *[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()], *[F.min(f"_l_{o}").alias(f"_n_{o}") for o in sums]
    )
    prev = W.partitionBy(*key).orderBy(*block).rowsBetween(W.unboundedPreceding, -1)
    for out in sums:
        tot = tot.withColumn(f"_b_{out}", F.coalesce(F.sum(f"_t_{out}").over(prev), F.lit(0)))
    for out in sums:
        tot = tot.withColumn(
            f"_p_{out}", F.least(F.lit(0), F.min(F.col(f"_b_{out}") + F.col(f"_n_{out}")).over(prev))
        )
    keep = [c for o in sums for c in (f"_b_{o}", f"_p_{o}")]
    res = loc.join(tot.select(*key, *block, *keep), key + block)
    for out in sums:
        res = res.withColumn(out, F.col(f"_b_{out}") + F.col(f"_l_{out}")).withColumn(
            f"{out}_min", F.least(F.col(f"_p_{out}"), F.col(f"_b_{out}") + F.col(f"_m_{out}"))
        )
    return res.drop(*keep, *[c for o in sums for c in (f"_l_{o}", f"_m_{o}")])
