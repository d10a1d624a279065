"""Cross-sectional operators: z-scores, ranks, factor definitions and fusion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barloom.operators.panel import by_symbol, full
from barloom.operators.scaling import avg_rank, correlation, beside, group_stats, pct_rank, with_rank, with_ranks

# Prior weights of the factor registry.
PRIOR_WEIGHTS = {
    "macd": 0.14,
    "momentum": 0.16,
    "moneyflow": 0.17,
    "quality": 0.11,
    "valuation": 0.11,
    "top_trader": 0.03,
    "liquidity": 0.03,
    "volatility": 0.03,
    "macro": 0.07,
    "financial_forward": 0.05,
    "event_driven": 0.05,
    "news_sentiment": 0.03,
}


def clip(c: Column, lo: float, hi: float) -> Column:
    """Bounded value; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c)))


def zscore(df: DataFrame, by: Sequence[str], cols: dict[str, str], bound: float = 3.0) -> DataFrame:
    """Group z-score with the sample deviation; 0 for no spread or missing, clipped.

    `cols` maps output to input; all columns share one aggregation."""
    aggs = [a for o, c in cols.items() for a in (F.avg(c).alias(f"_m_{o}"), F.stddev_samp(c).alias(f"_s_{o}"))]
    out = group_stats(df, by, *aggs) if by else beside(df, df.agg(*aggs))
    for o, c in cols.items():
        z = F.try_divide(F.col(c) - F.col(f"_m_{o}"), F.col(f"_s_{o}"))
        out = out.withColumn(o, F.coalesce(clip(z, -bound, bound), F.lit(0.0)))
    return out.drop(*[x for o in cols for x in (f"_m_{o}", f"_s_{o}")])


def percent_rank(df: DataFrame, by: Sequence[str], cols: dict[str, str]) -> DataFrame:
    """Average-tie percent ranks in (0, 1]; nulls stay null.

    Several columns are ranked in one pass over the long form, keyed by `symbol` + `by`."""
    cols = dict(cols)
    if len(cols) == 1:
        ((o, c),) = cols.items()
        return with_rank(df, by, c).withColumn(o, pct_rank()).drop("rk_below", "rk_ties", "rk_total")
    keys = ["symbol", *[b for b in by if b != "symbol"]]
    long = unpivot(df.select(*keys, *[F.col(c).cast("double").alias(o) for o, c in cols.items()]), keys, list(cols))
    ranked = with_rank(long, [*by, "factor"], "value").withColumn("_p", pct_rank())
    wide = ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("factor") == o, F.col("_p"))).alias(o) for o in cols])
    return df.drop(*[o for o in cols if o in df.columns]).join(wide, keys, "left")


def unpivot(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Long form (keys, factor, value)."""
    return df.unpivot(list(keys), list(cols), "factor", "value")


# --- factor definitions ---------------------------------------------------------------------


def momentum(panel: DataFrame, n: int = 21) -> DataFrame:
    """Return over the last n rows, per symbol."""
    w = W.partitionBy("symbol").orderBy(F.desc("trade_date"))
    t = panel.select("symbol", "trade_date", "close").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return t.groupBy("symbol").agg(
        (F.try_divide(F.max_by("close", "trade_date"), F.min_by("close", "trade_date")) - 1).alias("momentum_raw")
    )


def liquidity(panel: DataFrame, n: int = 20) -> DataFrame:
    """Last volume over the mean of the last n; 0 under five rows."""
    w = W.partitionBy("symbol").orderBy(F.desc("trade_date"))
    t = panel.select("symbol", "trade_date", "volume").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return t.groupBy("symbol").agg(
        F.when(F.count(F.lit(1)) < 5, 0.0)
        .otherwise(F.max_by("volume", "trade_date") / F.greatest(F.avg("volume"), F.lit(1.0)))
        .alias("liquidity_raw")
    )


def volatility(panel: DataFrame, n: int = 20) -> DataFrame:
    """Negated deviation of the returns between the last n closes; 0 under five rows."""
    w = W.partitionBy("symbol").orderBy(F.desc("trade_date"))
    t = panel.select("symbol", "trade_date", "close").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    t = t.withColumn("_r", F.try_divide(F.col("close"), F.lag("close").over(by_symbol())) - 1)
    return t.groupBy("symbol").agg(
        F.when(F.count(F.lit(1)) < 5, 0.0).otherwise(-F.stddev_samp("_r")).alias("volatility_raw")
    )


def quality(df: DataFrame) -> DataFrame:
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return df.withColumn(
        "quality_raw",
        z("roe") * 0.30
        + z("gross_profit_margin") * 0.20
        + z("net_profit_margin") * 0.20
        + z("revenue_growth") * 0.15
        + z("net_profit_growth") * 0.15,
    )


def valuation(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """-(z(pe) + z(pb)) / 2 over sane values only; missing counts as neutral."""
    df = df.withColumn("_pe", F.when((F.col("pe_ttm") > 0) & (F.col("pe_ttm") <= 200), F.col("pe_ttm")))
    df = df.withColumn("_pb", F.when((F.col("pb") > 0) & (F.col("pb") <= 100), F.col("pb")))
    df = zscore(df, by, {"_pez": "_pe", "_pbz": "_pb"})
    return df.withColumn("valuation", -(F.col("_pez") + F.col("_pbz")) / 2).drop("_pe", "_pb", "_pez", "_pbz")


# Industry class tilt by macro regime.
REGIME_TILT = {
    "boom": {"finance": 0.8, "cyclical": 0.8, "technology": 0.6, "consumer": 0.0, "health": -0.2, "defensive": -0.6},
    "normal": {"finance": 0.0, "cyclical": 0.0, "technology": 0.0, "consumer": 0.0, "health": 0.0, "defensive": 0.0},
    "recession": {"defensive": 0.8, "health": 0.6, "consumer": 0.4, "technology": -0.2, "finance": -0.4, "cyclical": -0.8},
}


def macro_regime(pmi: Column, m2: Column, cpi: Column) -> Column:
    """boom / normal / recession from three indicators; a missing one adds nothing."""
    pts = (
        F.when(pmi > 50.5, 1.0).when(pmi < 49.5, -1.0).otherwise(0.0)
        + F.when(m2 > 10.0, 0.5).when(m2 < 8.0, -0.5).otherwise(0.0)
        + F.when(cpi > 3.0, -0.5).when(cpi < 0.5, -0.5).when(cpi.isNotNull(), 0.3).otherwise(0.0)
    )
    return F.when(pts > 0.5, "boom").when(pts < -0.5, "recession").otherwise("normal")


def macro_tilt(regime: Column, industry_class: Column) -> Column:
    out = F.lit(0.0)
    for name, tilts in REGIME_TILT.items():
        for cls, t in tilts.items():
            if t:
                out = F.when((regime == name) & (industry_class == cls), t).otherwise(out)
    return out


# Surprise score of a forecast type.
SURPRISE = {
    "预增": 1.0, "扭亏": 1.0, "略增": 0.5, "续盈": 0.3, "续亏": -0.5,
    "略减": -0.5, "预减": -1.0, "首亏": -1.0, "不确定": 0.0,
}


def surprise_score(kind: Column, table: dict[str, float] = SURPRISE) -> Column:
    out = F.lit(0.0)
    for k, s in table.items():
        out = F.when(kind == k, s).otherwise(out)
    return out


def consensus(buy: Column, add: Column, sell: Column) -> Column:
    return buy * 1.0 + add * 0.5 - sell * 0.5


def forward_factor(df: DataFrame) -> DataFrame:
    """0.6 surprise + 0.4 analyst rank spread to [-1, 1]."""
    df = percent_rank(df, [], {"_pr": "analyst"})
    n = df.agg(F.countDistinct("analyst")).scalar()
    rank = F.when(n > 1, F.coalesce(F.col("_pr"), F.lit(0.5)) * 2 - 1).otherwise(0.0)
    return df.withColumn("forward_raw", F.coalesce("surprise", F.lit(0.0)) * 0.6 + rank * 0.4).drop("_pr")


def sentiment_raw(score: Column, count: Column) -> Column:
    return F.coalesce(score, F.lit(0.0)) * 0.7 + F.log1p(F.coalesce(count, F.lit(0)).cast("double")) * 0.3


def top_trader_raw(net: Column, count: Column) -> Column:
    return F.coalesce(net, F.lit(0.0)) + F.coalesce(count, F.lit(0)) * 10


FLOW_WEIGHTS = {3: 0.3, 5: 0.4, 10: 0.2, 20: 0.1}


def moneyflow_raw(prefix: str = "flow_", days: Sequence[int] = (3, 5, 10, 20)) -> Column:
    """Weighted mix of the available n-day flows."""
    total = sum(FLOW_WEIGHTS[d] for d in days)
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(f"{prefix}{d}"), F.lit(0.0)) * FLOW_WEIGHTS[d] for d in days]) / total


def flow_sums(daily: DataFrame, days: Sequence[int] = (3, 5, 10, 20)) -> DataFrame:
    """n-day net flow sums at the last row of each symbol, from daily (symbol, trade_date, net)."""
    from barloom.operators.panel import tail

    d = daily.withColumns({f"flow_{n}": F.sum("net").over(tail(n)) for n in days})
    return d.groupBy("symbol").agg(*[F.max_by(f"flow_{n}", "trade_date").alias(f"flow_{n}") for n in days])


# --- fusion ---------------------------------------------------------------------------------


def consensus_weights(
    df: DataFrame, factors: Sequence[str], prior: dict[str, float] = PRIOR_WEIGHTS, blend: float = 0.3, min_rows: int = 10
) -> DataFrame:
    """(factor, ic, weight): rank IC of each factor against the mean of the others, blended
    with the prior.  One row per factor, so the result may be broadcast safely."""
    names = [f for f in factors if prior.get(f, 0) > 0]
    total = reduce(lambda a, b: a + b, [F.col(f) for f in names])
    long = df.select(
        "symbol",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(f).alias("factor"), F.col(f).alias("v"), ((total - F.col(f)) / (len(names) - 1)).alias("c"))
                    for f in names
                ]
            )
        ).alias("s"),
    ).select("s.*")
    long = long.where(F.col("v").isNotNull() & F.col("c").isNotNull())
    rk = with_ranks(long, ["factor"], {"a": "v", "b": "c"})
    ic = rk.groupBy("factor").agg(
        correlation(avg_rank("a"), avg_rank("b")).alias("_rho"), F.count(F.lit(1)).alias("_n")
    ).withColumn("ic", F.when(F.col("_n") >= min_rows, F.greatest(F.lit(0.0), F.coalesce(F.nanvl("_rho", F.lit(0.0)), F.lit(0.0)))).otherwise(0.0))
    weight = F.lit(0.0)
    for f, p in prior.items():
        weight = F.when(F.col("factor") == f, p).otherwise(weight)
    every = W.partitionBy(F.lit(0))  # one row per factor
    ic = ic.withColumn("_p", weight).withColumn("_t", F.sum("ic").over(every))
    usable = (F.col("_t") > 0) & F.lit(len(names) >= 3)
    ic = ic.withColumn("_b", F.when(usable, (1 - blend) * F.col("_p") + blend * F.col("ic") / F.col("_t")).otherwise(F.col("_p")))
    # The prior of factors outside the frame also enters the normaliser.
    rest = sum(p for f, p in prior.items() if f not in names)
    norm = F.sum("_b").over(every) + F.when(usable, (1 - blend) * rest).otherwise(rest)
    return ic.select("factor", "ic", F.when(usable, F.col("_b") / norm).otherwise(F.col("_b")).alias("weight"))


def fuse(df: DataFrame, factors: Sequence[str], weights: DataFrame) -> DataFrame:
    """Weighted sum of the factors and its 1..100 percentile, joined on symbol."""
    long = unpivot(df.select("symbol", *factors), ["symbol"], factors)
    fused = long.join(weights.select("factor", "weight"), "factor").groupBy("symbol").agg(
        F.sum(F.col("value") * F.col("weight")).alias("fused")
    )
    fused = percent_rank(fused, [], {"_p": "fused"}).withColumn("score", F.col("_p") * 99 + 1).drop("_p")
    return df.join(fused, "symbol", "left")


# Numeric strength of an industry signal.
INDUSTRY_SIGNAL_SCORE = {"core": 80, "momentum": 70, "contrarian": 50, "neutral": 40, "overheated": 30}


def neutralise(df: DataFrame, score: str = "score", industry: str = "industry") -> DataFrame:
    """Percentile within industry and the discount for diverging from the industry signal."""
    df = percent_rank(df, [industry], {"_p": score})
    sig = F.lit(50)
    for k, s in INDUSTRY_SIGNAL_SCORE.items():
        sig = F.when(F.col("industry_signal") == k, s).otherwise(sig)
    df = df.withColumn("industry_pct", F.coalesce(F.col("_p") * 100, F.lit(50.0))).withColumn("industry_signal_score", sig)
    dev = (
        F.when((F.col("industry_pct") <= 25) & (F.col("industry_signal_score") >= 70), -10)
        .when((F.col("industry_pct") >= 75) & (F.col("industry_signal_score") <= 40), -5)
        .otherwise(0)
    )
    return df.withColumn("industry_deviation", dev).withColumn(
        score, F.greatest(F.col(score) + F.col("industry_deviation"), F.lit(0.0))
    ).drop("_p")


def industry_trend(bars: DataFrame, valuation: DataFrame, periods: Sequence[int] = (10, 20, 30, 60, 90)) -> DataFrame:
    """Industry scores from value, trend and volume ranks, and the five-way signal.

    `bars` holds one index series per industry in `symbol`; `valuation` has pe_ttm, pb, div_yield."""
    from barloom.operators.panel import last_rows

    df = bars.withColumns({f"ma_{p}": full(F.avg("close"), p) for p in periods})
    df = df.withColumn("_v20", full(F.avg("volume"), 20, src="volume")).withColumn("_a60", full(F.avg("amount"), 60, src="amount"))
    df = last_rows(df)
    mas = [F.col(f"ma_{p}") for p in periods]
    steps = reduce(lambda a, b: a + b, [F.coalesce((a > b).cast("int"), F.lit(0)) for a, b in zip(mas, mas[1:])])
    df = df.withColumns(
        {
            "bull_align": steps,
            "dev_60": F.try_divide(F.col("close") - F.col("ma_60"), F.col("ma_60")) * 100,
            "vol_ratio": F.try_divide(F.col("volume"), F.col("_v20")),
            "amt_ratio": F.try_divide(F.col("amount"), F.col("_a60")),
        }
    ).join(valuation, "symbol", "left")
    df = df.withColumns(
        {
            "pe_ttm": F.when(F.col("pe_ttm") > 0, F.col("pe_ttm")),
            "pb": F.when(F.col("pb") > 0, F.col("pb")),
            "div_yield": F.coalesce("div_yield", F.lit(0.0)),
        }
    )
    df = percent_rank(df, [], {"r_pe": "pe_ttm", "r_pb": "pb", "r_div": "div_yield", "r_mom": "dev_60", "r_vol": "vol_ratio", "r_amt": "amt_ratio"})
    df = df.withColumn("factor_value", (100 - F.col("r_pe") * 100) * 0.4 + (100 - F.col("r_pb") * 100) * 0.3 + F.col("r_div") * 100 * 0.3)
    df = df.withColumn("factor_trend", F.col("bull_align") / 4.0 * 100 * 0.5 + F.col("r_mom") * 100 * 0.5)
    df = df.withColumn("factor_volume", F.col("r_vol") * 100 * 0.5 + F.col("r_amt") * 100 * 0.5)
    df = df.withColumn(
        "total_score", F.coalesce("factor_value", F.lit(50.0)) * 0.35 + F.col("factor_trend") * 0.40 + F.col("factor_volume") * 0.25
    )
    v, t, s = F.col("factor_value"), F.col("factor_trend"), F.col("total_score")
    return df.withColumn(
        "industry_signal",
        F.when((s > 75) & (v > 70), "core")
        .when((s > 70) & (t > 80), "momentum")
        .when((v > 85) & (t < 40), "contrarian")
        .when((t > 80) & (v < 30), "overheated")
        .otherwise("neutral"),
    ).select("symbol", "bull_align", "factor_value", "factor_trend", "factor_volume", "total_score", "industry_signal")


def fund_momentum(t5: Column, t10: Column, t20: Column, w_trend: float = 0.4, w_speed: float = 0.6) -> dict[str, Column]:
    """Participation and acceleration of the 5-day flow, their mix and a signal class."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c01 = lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))
    trend = c01(share(t5, t10) * 0.5 + share(t5, t20) * 0.25)
    eps = 1e-5
    g10 = F.try_divide(t5 / 5 - t10 / 10, t10 / 10 + eps)
    g20 = F.try_divide(t5 / 5 - t20 / 20, t20 / 20 + eps)
    speed = c01(g10 / 0.5) * 0.4 + c01(g20 / 0.5) * 0.6
    signal = (
        F.when(t5 <= 0, "outflow")
        .when((trend >= 0.6) & (speed >= 0.6), "strong_advance")
        .when((trend < 0.3) & (speed >= 0.6), "returning")
        .when((trend >= 0.6) & (speed < 0.3), "fading")
        .when((speed >= 0.3) & (speed < 0.6), "mild_inflow")
        .otherwise("watch")
    )
    return {"flow_trend": trend, "flow_speed": speed, "flow_momentum": trend * w_trend + speed * w_speed, "flow_signal": signal}


def rescore(df: DataFrame, weights: dict[str, float], out: str = "score") -> DataFrame:
    """Weighted factor sum spread to 0..100 by the table's own range; 0 when flat."""
    raw = reduce(lambda a, b: a + b, [F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in weights.items()])
    df = df.withColumn("_raw", raw)
    t = df.agg(F.struct(F.min("_raw").alias("lo"), F.max("_raw").alias("hi"))).scalar()
    return df.withColumn(
        out, F.coalesce(F.try_divide(F.col("_raw") - t.getField("lo"), t.getField("hi") - t.getField("lo")) * 100, F.lit(0.0))
    ).drop("_raw")
