"""Price limits: classification, fill calibration and market state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barloom.operators.panel import by_symbol
from barloom.operators.scaling import quantiles

EPS = 1e-9
REFORM = "2023-04-10"  # first five days exempt from here on


def half_up(x: Column) -> Column:
    """Exchange rounding to 0.01, through decimals so that x.xx5 always goes up."""
    return F.round(F.round(x, 8).cast("decimal(30,8)"), 2).cast("double")


def limit_ratio(is_st: Column, listing_days: Column, day: Column) -> tuple[Column, Column]:
    """(up, down) ratios: 5 % under special treatment, 10 % otherwise, 44/36 % on the first
    day before the reform, effectively none in the first five days after it."""
    new = day >= F.lit(REFORM).cast("date")
    exempt = F.coalesce((listing_days <= 5) & new, F.lit(False))
    first = F.coalesce((listing_days == 1) & ~new, F.lit(False))
    plain = F.when(is_st, 0.05).otherwise(0.10)
    return F.when(exempt, 1.0).when(first, 0.44).otherwise(plain), F.when(exempt, 1.0).when(first, 0.36).otherwise(plain)


def exright_reference(prev_close: Column, factor: Column, prev_factor: Column) -> Column:
    """Ex-rights reference: the cumulative factor rises on the ex-date, so the reference is
    prev_close * previous / today, while the ratio is plausible."""
    ratio = F.try_divide(prev_factor, factor)
    return F.when((factor > 0) & (prev_factor > 0) & (ratio > 0.1) & (ratio < 5.0), prev_close * ratio).otherwise(prev_close)


def classify(raw: DataFrame, ratio: float = 0.10) -> DataFrame:
    """Touch type, auction type and signed streak of closes at the limit, from raw bars."""
    w = by_symbol()
    pc = F.lag("close").over(w)
    df = raw.withColumn("limit_up", half_up(pc * (1 + ratio))).withColumn("limit_down", half_up(pc * (1 - ratio)))
    at = lambda c, side: F.coalesce(F.col(c) >= F.col("limit_up") - EPS if side > 0 else F.col(c) <= F.col("limit_down") + EPS, F.lit(False))
    df = df.withColumns({"_ou": at("open", 1), "_od": at("open", -1), "_cu": at("close", 1), "_cd": at("close", -1)})
    tu, td = F.col("_cu") | at("high", 1), F.col("_cd") | at("low", -1)
    # The down side wins where a bar is at both limits, as it is assigned last.
    day = (
        F.when(F.col("_cd") & F.col("_od"), "seal_down").when(F.col("_cu") & F.col("_ou"), "seal_up")
        .when(F.col("_ou") & ~F.col("_cu"), "open_up").when(F.col("_od") & ~F.col("_cd"), "open_down")
        .when(tu & ~F.col("_ou"), "intraday_up").when(td & ~F.col("_od"), "intraday_down").otherwise("")
    )
    df = df.withColumn("day_type", day).withColumn("auction_type", F.when(F.col("_od"), "auction_down").when(F.col("_ou"), "auction_up").otherwise(""))
    df = df.withColumn("_k", F.col("_cu").cast("int") - F.col("_cd").cast("int"))
    df = df.withColumn("_new", F.coalesce((F.col("_k") != F.lag("_k").over(w)).cast("int"), F.lit(1)))
    df = df.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    n = F.row_number().over(W.partitionBy("symbol", "_run").orderBy("trade_date"))
    return df.withColumn("streak", F.when(F.col("_k") == 0, 0).otherwise(n * F.col("_k"))).drop("_ou", "_od", "_cu", "_cd", "_k", "_new", "_run")


def fill_ratio(kind: Column, streak: Column, decay: float = 0.5) -> Column:
    """Tradable share of a day's volume by touch type, decayed by the streak."""
    base = F.when(kind.startswith("seal"), 0.05).when(kind.startswith("open"), 0.30).when(kind.startswith("intraday"), 0.10)
    base = F.when(kind.startswith("auction"), 0.30).otherwise(base)
    return F.when(base.isNotNull(), base * F.pow(F.lit(decay), F.greatest(F.abs(streak) - 1, F.lit(0)))).otherwise(1.0)


def streak_bucket(streak: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(3), F.abs(streak)))


def calibrate(classified: DataFrame, kind: str = "day_type") -> DataFrame:
    """Volume over the previous volume by (touch type, streak bucket): count, p10, p50, p90."""
    r = F.try_divide(F.col("volume"), F.lag("volume").over(by_symbol()))
    d = classified.withColumn("r", r).withColumn("bucket", streak_bucket(F.col("streak")))
    d = d.where((F.col(kind) != "") & (F.col("r") > 0) & (F.col("r") <= 10)).select(F.col(kind).alias("kind"), "bucket", "r")
    n = d.groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return n.join(quantiles(d, ["kind", "bucket"], "r", {"p10": 0.1, "p50": 0.5, "p90": 0.9}), ["kind", "bucket"])


def calibrated_fill(classified: DataFrame, table: DataFrame, percentile: float = 0.5, min_samples: int = 30) -> DataFrame:
    """Auction fill ratio from the table; the fixed ratio where samples are too few."""
    col = "p10" if percentile <= 0.11 else "p50" if percentile >= 0.49 else "p90"
    t = table.where(F.col("n") >= min_samples).select(F.col("kind").alias("auction_type"), "bucket", F.least(F.greatest(F.col(col), F.lit(0.0)), F.lit(1.0)).alias("_r"))
    d = classified.withColumn("bucket", streak_bucket(F.col("streak"))).join(t, ["auction_type", "bucket"], "left")
    return d.withColumn("fill", F.coalesce("_r", fill_ratio(F.col("auction_type"), F.col("streak")))).drop("_r")


def daily_counts(classified: DataFrame) -> DataFrame:
    n = lambda cond: F.sum(cond.cast("int"))
    return classified.groupBy("trade_date").agg(
        *[n(F.col("day_type") == k).alias(k) for k in ("seal_up", "seal_down", "open_up")], n(F.col("auction_type") != "").alias("auction_touch")
    )


def stress_windows(counts: DataFrame, kind: str, days: int = 5, top: int = 3) -> DataFrame:
    """Busiest non-overlapping windows of `days` rows, highest count first, then the earlier one.

    The pick is a fold over one sorted array with an element for each trading day of the market: a window
    is taken if it is `days` rows away from all that are taken already."""
    w = W.partitionBy(F.lit(0)).orderBy("trade_date")  # one row per trading day
    span = w.rowsBetween(-(days - 1), 0)
    c = counts.select(F.row_number().over(w).alias("i"), F.sum(kind).over(span).alias("count"), F.min("trade_date").over(span).alias("start"), F.col("trade_date").alias("end"))
    busy = c.where((F.col("i") >= days) & (F.col("count") > 0)).select(F.struct(-F.col("count"), "i", "start", "end", "count").alias("x"))
    listed = busy.agg(F.array_sort(F.collect_list("x")).alias("all"))
    kind_of = listed.schema["all"].dataType.simpleString()
    free = lambda taken, x: F.forall(taken, lambda t: F.abs(t["i"] - x["i"]) >= days)
    picked = F.aggregate("all", F.array().cast(kind_of), lambda taken, x: F.when((F.size(taken) < top) & free(taken, x), F.concat(taken, F.array(x))).otherwise(taken))
    out = listed.select(F.explode(picked).alias("x"))
    return out.select("x.start", "x.end", F.col("x.count").cast("bigint").alias("count"), (F.col("x.count") / days).alias("mean_per_day"))


def market_state(bars: DataFrame, full_at: float = 0.02, half_at: float = -0.02, vol_max: float = 0.8) -> DataFrame:
    """Daily market multiplier from the median 20-day return and the percentile of the
    cross-sectional volatility in its last 250 days (0.5 until 60 exist)."""
    w = by_symbol()
    r = bars.select("trade_date", (F.col("close") / F.lag("close").over(w) - 1).alias("r1"), (F.col("close") / F.lag("close", 20).over(w) - 1).alias("r20"))
    med = quantiles(r, ["trade_date"], "r20", {"ret20": 0.5})
    d = r.groupBy("trade_date").agg(F.stddev_samp("r1").alias("vol")).join(med, "trade_date", "left").where("vol is not null")
    t = W.partitionBy(F.lit(0)).orderBy("trade_date").rowsBetween(-249, 0)  # one row per date
    d = d.withColumn("_h", F.collect_list("vol").over(t))
    pct = F.size(F.filter("_h", lambda x: x <= F.col("vol"))) / F.size("_h")
    d = d.withColumn("vol_pct", F.when(F.size("_h") < 60, 0.5).otherwise(pct))
    m = F.when(F.col("ret20") >= full_at, 1.0).when((F.col("ret20") >= half_at) & (F.col("vol_pct") <= vol_max), 0.5).otherwise(0.25)
    return d.select("trade_date", "ret20", "vol", "vol_pct", m.alias("multiplier"))


def breadth(returns: DataFrame, min_rows: int = 100) -> DataFrame:
    """Share of rising names per day and its risk level."""
    g = returns.where("ret is not null").groupBy("trade_date").agg(F.avg((F.col("ret") > 0).cast("double")).alias("up_share"), F.count(F.lit(1)).alias("n"))
    u = F.col("up_share")
    return g.withColumn(
        "breadth_risk", F.when(F.col("n") <= min_rows, "UNKNOWN").when(u < 0.25, "HIGH").when((u < 0.35) | (u > 0.70), "MEDIUM").otherwise("LOW")
    )
