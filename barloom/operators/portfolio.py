"""Position sizing, exposure caps and allocation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from barloom.operators.cross_section import clip
from barloom.operators.scaling import group_stats


@dataclass(frozen=True)
class SizingParams:
    """Fixed values of the sizing rule."""

    max_single: float = 0.33
    kelly_fraction: float = 0.25
    win_rate: float = 0.55
    risk_budget: float = 0.02
    atr_stop_mult: float = 1.5
    risk_none: float = 1.0


def _map(c: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, x in table.items():
        out = F.when(c == k, x).otherwise(out)
    return out


def size_positions(df: DataFrame, p: SizingParams = SizingParams()) -> DataFrame:
    """Suggested position, volatility cap and a reason text from level, score, risk, trend,
    reward-to-risk and rule adjustment."""
    level = F.upper(F.trim(F.coalesce("level", F.lit("C"))))
    risk = F.upper(F.trim(F.coalesce("risk_level", F.lit("MEDIUM"))))
    trend = F.coalesce("macd_trend", F.lit(""))
    df = df.withColumns(
        {
            "_lb": _map(level, {"A": 0.30, "B": 0.15, "C": 0.05, "D": 0.0}, 0.03),
            "_sf": F.coalesce(clip(F.col("score"), 0, 100), F.lit(0.0)) / 100.0,
            "_rm": _map(risk, {"NONE": p.risk_none, "LOW": 0.85, "MEDIUM": 0.50, "HIGH": 0.0}, 0.50),
            "_tm": _map(trend, {"SUPER_STRONG": 1.0, "STRONG": 0.85, "WEAK": 0.40, "SUPER_WEAK": 0.0}, 0.50),
            "_rrr": F.coalesce("exit_rrr", F.lit(0.0)),
            "_adj": F.coalesce(clip(F.col("position_adjust"), -1, 1), F.lit(0.0)),
        }
    )
    rrr = F.col("_rrr")
    kelly = F.greatest(F.try_divide(p.win_rate * rrr - (1 - p.win_rate), rrr), F.lit(0.0)) * p.kelly_fraction
    mod = F.when(rrr <= 0, 1.0).when(rrr <= 1.0, 0.7).otherwise(clip(0.8 + kelly * 0.7, 0.5, 1.5))
    c, s = F.coalesce("close", F.lit(0.0)), F.coalesce("stop_loss", F.lit(0.0))
    atr_pct = F.when((c > 0) & (s > 0) & (s < c), (c - s) / (p.atr_stop_mult * c))
    cap = F.coalesce(clip(F.when(atr_pct > 0.001, p.risk_budget / atr_pct), 0, p.max_single), F.lit(p.max_single))
    df = df.withColumn("_km", mod).withColumn("vol_cap", cap)
    pos = F.col("_lb") * F.col("_sf") * F.col("_rm") * F.col("_tm") * F.col("_km") * (1 + F.col("_adj"))
    df = df.withColumn("position", F.when((risk == "HIGH") | (F.col("_tm") <= 0), 0.0).otherwise(F.round(clip(pos, 0, p.max_single), 4)))
    reason = F.when(risk == "HIGH", "high risk: flat").when(F.col("_tm") <= 0, F.concat(F.lit("weakest trend: flat ("), trend, F.lit(")"))).otherwise(
        F.concat_ws(
            " | ",
            F.concat(F.lit("level "), level),
            F.when(F.col("_rm") < 1, F.concat(F.lit("risk "), risk)),
            F.when(F.col("_tm") < 1, F.concat(F.lit("trend "), trend)),
            F.when(rrr > 1, "kelly").when(rrr > 0, "low reward").otherwise("no reward ratio"),
            F.when(F.col("vol_cap") < p.max_single, "volatility cap"),
            F.when(F.col("_adj") != 0, "rule adjustment"),
        )
    )
    return df.withColumn("position_reason", reason).drop("_lb", "_sf", "_rm", "_tm", "_rrr", "_adj", "_km")


def impact_cap(
    df: DataFrame, nav: float = 1_000_000.0, threshold: float = 0.01, base: float = 0.002, max_impact: float = 0.02
) -> DataFrame:
    """Shrink a position whose estimated impact cost is over the limit to the safe size."""
    part = F.col("position") * nav / F.col("amount")
    impact = F.when((F.col("position") > 0) & (F.col("amount") > 0) & (part > threshold), base * F.pow(part / threshold, 1.5))
    safe = threshold * (max_impact / base) ** (1 / 1.5) * F.col("amount") / nav
    return df.withColumn("impact", F.coalesce(impact, F.lit(0.0))).withColumn(
        "position", F.when(F.col("impact") > max_impact, F.least(safe, F.col("position"))).otherwise(F.col("position"))
    )


def industry_cap(df: DataFrame, limit: float = 0.30, industry: str = "industry", score: str = "score") -> DataFrame:
    """In an industry over the limit keep the best-scored row, capped; the rest go to 0.
    Ties go to the lowest symbol."""
    best = F.max(F.struct(F.col(score), (-F.col("symbol")).alias("s")))
    df = group_stats(df, [industry], F.sum("position").alias("_tot"), best.alias("_best"))
    keep = F.col("symbol") == -F.col("_best.s")
    return df.withColumn(
        "position",
        F.when(F.col("_tot") <= limit, F.col("position")).when(keep, F.least(F.col("position"), F.lit(limit))).otherwise(0.0),
    ).drop("_tot", "_best")


def scale_to(df: DataFrame, limit: float, target: float | None = None) -> DataFrame:
    """Scale all positions when their sum passes the limit (to `target`, default the limit)."""
    t = df.agg(F.sum("position")).scalar()
    k = (limit if target is None else target) / t
    return df.withColumn("position", F.when(t > limit, F.col("position") * k).otherwise(F.col("position")))


def constrain(df: DataFrame) -> DataFrame:
    """Impact, industry, turnover and total caps in the order the daily run applies them."""
    return scale_to(scale_to(industry_cap(impact_cap(df)), 0.5), 1.0, 0.95)


def align_weights(target: DataFrame, previous: DataFrame) -> DataFrame:
    """Outer alignment of (symbol, weight) tables; missing means 0."""
    t = target.select("symbol", F.col("weight").alias("_t"))
    p = previous.select("symbol", F.col("weight").alias("_p"))
    return t.join(p, "symbol", "full_outer").select(
        "symbol", F.coalesce("_t", F.lit(0.0)).alias("target"), F.coalesce("_p", F.lit(0.0)).alias("previous")
    )


def turnover(aligned: DataFrame) -> DataFrame:
    return aligned.agg((F.sum(F.abs(F.col("target") - F.col("previous"))) / 2).alias("turnover"))


def cap_turnover(aligned: DataFrame, max_turnover: float = 0.5, max_total: float = 0.95) -> DataFrame:
    """Compress the moves towards the previous weights until turnover fits, then cap the total."""
    t = turnover(aligned).scalar()
    k = F.when(t > max_turnover, max_turnover / t).otherwise(1.0)
    df = aligned.withColumn("weight", F.col("previous") + (F.col("target") - F.col("previous")) * k)
    s = df.agg(F.sum("weight")).scalar()
    return df.withColumn("weight", F.when((t > max_turnover) & (s > max_total), F.col("weight") * max_total / s).otherwise(F.col("weight")))


def rebalance_cost(target: Column, previous: Column, commission=0.0003, stamp=0.0005, transfer=0.00001) -> Column:
    """Cost of a weight change as a share of net value; stamp duty on sells only."""
    d = F.abs(target - previous)
    rate = commission * 2 + F.when(target < previous, stamp).otherwise(0.0) + transfer * 2
    return F.when(d < 1e-8, 0.0).otherwise(d * rate)


def score_weights(df: DataFrame, min_score: float, cap: float, risk_none: float = 1.0) -> DataFrame:
    """Inverse-risk weights of the candidates, capped and renormalised."""
    risk = _map(F.upper(F.col("risk_level")), {"NONE": risk_none, "LOW": 1.5, "MEDIUM": 3.0, "HIGH": 5.0, "D": 8.0}, 3.0)
    df = df.where(F.col("score") >= min_score).withColumn("_w", F.least(1.0 / risk, F.lit(cap)))
    t = df.agg(F.sum("_w")).scalar()
    return df.withColumn("weight", F.col("_w") / t).drop("_w")


def top_per_day(df: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Best k rows per day.  The day's rows are first cut to k per hash bucket, so the final
    window sees at most 64*k rows whatever the size of the day."""
    from pyspark.sql import Window as W

    order = [F.desc(score), F.asc("symbol")]
    b = df.withColumn("_b", F.pmod(F.xxhash64("symbol"), F.lit(64)))
    first = b.withColumn("_r", F.row_number().over(W.partitionBy("trade_date", "_b").orderBy(*order))).where(F.col("_r") <= k)
    return first.withColumn("rank", F.row_number().over(W.partitionBy("trade_date").orderBy(*order))).where(F.col("rank") <= k).drop("_b", "_r")
