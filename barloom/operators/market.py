"""Index-level risk and event, flow and valuation aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def index_risk(index_bars: DataFrame) -> DataFrame:
    """Trend and price-volume risk of one index per day, with the combined decision.

    The input has one row per trading day, so a single ordered window is small."""
    w = W.partitionBy(F.lit(0)).orderBy("trade_date")
    win = lambda agg, n: F.when(F.count(F.lit(1)).over(w.rowsBetween(-(n - 1), 0)) >= n, agg.over(w.rowsBetween(-(n - 1), 0)))
    c = F.col("close")
    df = index_bars.withColumns(
        {
            "_m60": win(F.avg("close"), 60),
            "_m120": win(F.avg("close"), 120),
            "_l60": win(F.min("low"), 60),
            "_chg": c / F.lag("close").over(w) * 100 - 100,
            "_ar": F.try_divide(win(F.avg("volume"), 5), win(F.avg("volume"), 20)),
        }
    )
    m60, m120, chg, ar = F.col("_m60"), F.col("_m120"), F.col("_chg"), F.col("_ar")
    t = (
        F.when(m120.isNull(), "NORMAL")
        .when(c < F.col("_l60") * 1.02, "HIGH_RISK")
        .when((c < m60) & (m60 < m120), "HIGH_RISK")
        .when((c < m60) & (m60 > m120), "MEDIUM_RISK")
        .otherwise("NORMAL")
    )
    v = (
        F.when((chg < -1) & (ar <= 0.8), "HIGH_RISK")
        .when((chg < -2) & (ar >= 1.5), "MEDIUM_RISK")
        .when((chg > 1) & (ar <= 0.7), "HIGH_RISK")
        .otherwise("NORMAL")
    )
    df = df.select("trade_date", t.alias("trend_risk"), v.alias("volume_risk"))
    return decide(df, ["trend_risk", "volume_risk"])


def decide(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """SKIP_ALL / CAUTION / NORMAL and the score multiplier from any number of risk levels."""
    any_of = lambda x: reduce(lambda a, b: a | b, [F.col(c) == x for c in levels])
    high, mid = any_of("HIGH_RISK"), any_of("MEDIUM_RISK")
    return df.withColumn("decision", F.when(high, "SKIP_ALL").when(mid, "CAUTION").otherwise("NORMAL")).withColumn(
        "score_adjust", F.when(high, 1.0).when(mid, 0.85).otherwise(1.0)
    )


def last_dates(df: DataFrame, n: int) -> DataFrame:
    """Rows of the last n distinct dates."""
    d = df.select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(n)
    return df.join(d, "trade_date", "left_semi")


def appearance_stats(df: DataFrame, value: str, days: int) -> DataFrame:
    """Sum, mean and count of a per-day list over its last `days` dates."""
    return last_dates(df, days).groupBy("symbol").agg(
        F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("appearances")
    )


def flow_stats(df: DataFrame, value: str, holding: str, days: int) -> DataFrame:
    """As above with the mean holding; trend = mean times count."""
    g = last_dates(df, days).groupBy("symbol").agg(
        F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"), F.avg(holding).alias("mean_holding")
    )
    return g.withColumn("trend", F.col("mean") * F.col("n"))


# Sentiment keywords.
POSITIVE = (
    "利好", "增长", "突破", "盈利", "新高", "涨停", "大涨", "买入", "推荐", "增持", "回购",
    "分红", "龙头", "扩张", "创新", "领先", "优势", "提振", "回暖", "复苏", "加速", "放量",
)
NEGATIVE = (
    "利空", "下跌", "亏损", "减持", "跌停", "大跌", "卖出", "回避", "风险", "暴雷", "违约",
    "诉讼", "处罚", "调查", "退市", "ST", "下滑", "萎缩", "放缓", "收缩", "预警",
)


def title_sentiment(text: Column, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> Column:
    """(positive hits - negative hits) / hits, each keyword counted once, in [-1, 1]."""
    hits = lambda words: reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words])
    p, n = hits(positive), hits(negative)
    return F.coalesce((p - n) / F.greatest(p + n, F.lit(1)), F.lit(0.0))


def sentiment_stats(news: DataFrame, text: str, by: Sequence[str] = ("symbol",), positive=POSITIVE, negative=NEGATIVE) -> DataFrame:
    s = news.withColumn("_s", title_sentiment(F.col(text), positive, negative))
    return s.groupBy(*by).agg(
        F.sum("_s").alias("score"), F.sum((F.col("_s") > 0).cast("int")).alias("positive"),
        F.sum((F.col("_s") < 0).cast("int")).alias("negative"), F.count(F.lit(1)).alias("total"),
    )


def signed_flow(kind: Column, inflow: Sequence[str], amount: Column) -> Column:
    return F.when(kind.isin(*inflow), amount).otherwise(-amount)


def event_score(sources: Sequence[tuple[DataFrame, bool]]) -> DataFrame:
    """Each (symbol, amount) source scaled by its largest (absolute if the flag is set) amount
    plus one, summed per symbol, scaled by the largest absolute sum."""
    parts = []
    for df, signed in sources:
        top = df.agg(F.max(F.abs("amount") if signed else F.col("amount"))).scalar()
        parts.append(df.select("symbol", (F.col("amount") / (top + 1)).alias("_e")))
    g = reduce(DataFrame.unionByName, parts).groupBy("symbol").agg(F.sum("_e").alias("_e"))
    top = g.agg(F.max(F.abs("_e"))).scalar()
    return g.select("symbol", F.coalesce(F.try_divide(F.col("_e"), top), F.lit(0.0)).alias("event_score"))


def weighted_valuation(df: DataFrame, by: str, ratios: Sequence[str], cap: str, dividend: str, full: bool = False) -> DataFrame:
    """Harmonic cap-weighted ratios per industry.

    Profitable mode uses members with cap > 0 and ratio > 0 on both sides; full mode divides
    the whole cap by the earnings of every member with a non-zero ratio, losses included."""
    mv = F.col(cap)
    aggs = []
    for c in ratios:
        x = F.col(c)
        if full:
            num = F.sum(F.when(mv > 0, mv))
            den = F.sum(F.when(x.isNotNull() & (x != 0), F.try_divide(mv, x)))
        else:
            ok = (mv > 0) & (x > 0)
            num, den = F.sum(F.when(ok, mv)), F.sum(F.when(ok, F.try_divide(mv, x)))
        aggs.append(F.when(F.abs(den) >= 1e-12, num / den).alias(c))
    ok = (mv > 0) & F.col(dividend).isNotNull()
    aggs.append(F.try_divide(F.sum(F.when(ok, mv * F.col(dividend))), F.sum(F.when(ok, mv))).alias(dividend))
    return df.groupBy(by).agg(*aggs)


def holder_position(cost: Column, price: Column, participation: Column) -> dict[str, Column]:
    """Main-holder cost against price: difference, percentage, class and control strength."""
    pct = F.try_divide(price - cost, cost) * 100
    p = participation
    return {
        "cost_diff": price - cost,
        "cost_pct": pct,
        "cost_class": F.when(price > cost, F.when(pct > 10, "far_above").otherwise("above"))
        .when(price < cost, F.when(pct < -10, "far_below").otherwise("below"))
        .otherwise("at_cost"),
        "participation_class": F.when(p <= 20, "low").when(p <= 50, "mid_low").when(p <= 80, "mid_high").otherwise("high"),
        "control_strength": F.when((p >= 80) & (F.abs(pct) <= 10), "high")
        .when((p >= 50) & (F.abs(pct) <= 15), "medium")
        .when(p >= 20, "light")
        .otherwise("low"),
    }
