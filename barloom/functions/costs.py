"""Trading costs as columns.  Rates by date are fixed values of the market's fee history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values: (first day, rate), newest first.
STAMP = (
    ("2023-08-28", 0.0005),
    ("2008-09-19", 0.001),
    ("2008-04-24", 0.001),
    ("2007-05-30", 0.003),
    ("2005-01-24", 0.001),
    ("2000-01-01", 0.002),
)
TRANSFER = (("2022-04-29", 0.00001), ("2015-08-01", 0.00002), ("2012-09-01", 0.00006), ("2000-01-01", 0.00006))
HANDLING = (("2023-08-28", 0.0000341), ("2015-08-01", 0.0000487), ("2000-01-01", 0.0000696))
REGULATOR = (("2015-08-01", 0.00002), ("2000-01-01", 0.00004))
STAMP_BOTH_SIDES_BEFORE = "2008-09-19"
TRANSFER_ALL_MARKETS_FROM = "2022-04-29"
TRANSFER_BY_VALUE_FROM = "2012-09-01"
TRANSFER_PER_SHARE = 0.001

# Fixed values by liquidity tier, least liquid first.
TIER_EDGES = (5_000_000.0, 20_000_000.0, 100_000_000.0)
TIER_IMPACT_BASE = (0.008, 0.003, 0.0015, 0.001)
TIER_THRESHOLD = (0.005, 0.01, 0.01, 0.02)
TIER_CAP = (0.10, 0.05, 0.05, 0.03)
TIER_SLIPPAGE_FLOOR = (0.0018, 0.0012, 0.0008, 0.0005)
MIN_SLIPPAGE = 0.0005
LIMIT_SLIPPAGE = 0.0005


def rate_on(day: Column, segments, default: float) -> Column:
    """Rate of the latest segment that started by the day."""
    out = F.lit(default)
    for start, rate in reversed(segments):
        out = F.when(day >= F.lit(start).cast("date"), rate).otherwise(out)
    return out


def liquidity_tier(amount_ma20: Column) -> Column:
    """0 = least liquid; -1 without data."""
    out = F.lit(len(TIER_EDGES))
    for i in reversed(range(len(TIER_EDGES))):
        out = F.when(amount_ma20 < TIER_EDGES[i], i).otherwise(out)
    return F.when(amount_ma20 > 0, out).otherwise(-1)


def by_tier(tier: Column, values, default: float) -> Column:
    out = F.lit(default)
    for i, v in enumerate(values):
        out = F.when(tier == i, v).otherwise(out)
    return out


def commission_rate(value: Column, flat: float, tiers=()) -> Column:
    """Rate of the highest tier (from value, rate) that the value reaches; `flat` below the first."""
    out = F.lit(flat)
    for start, rate in sorted(tiers):
        out = F.when(value >= start, rate).otherwise(out)
    return out


def transfer_fee(day: Column, main_market: Column, value: Column, shares: Column) -> Column:
    """Both markets by value since 2022; before that the main market only, by value since
    2012 and per share earlier."""
    by_value = value * rate_on(day, TRANSFER, 0.00001)
    return (
        F.when(day >= F.lit(TRANSFER_ALL_MARKETS_FROM).cast("date"), by_value)
        .when(~main_market, 0.0)
        .when(day >= F.lit(TRANSFER_BY_VALUE_FROM).cast("date"), by_value)
        .otherwise(shares * TRANSFER_PER_SHARE)
    )


def with_costs(
    trades: DataFrame,
    *,
    commission: float = 0.0003,
    min_commission: float = 5.0,
    slippage: float = 0.001,
    all_in_commission: bool = True,
    commission_tiers=(),
    limit_slippage: float = LIMIT_SLIPPAGE,
) -> DataFrame:
    """Cost columns for trades with value, qty, adv, amount_ma20, amplitude, trade_date,
    action and main_market: commission, stamp, transfer, handling, regulator, slippage,
    impact, total.  With a column order_type, orders other than `market` slip by
    `limit_slippage` (null: market); tier floors hold for both."""
    day, value, sell = F.col("trade_date"), F.col("value"), F.col("action") != "buy"
    df = trades.withColumn("_tier", liquidity_tier(F.col("amount_ma20")))
    t = F.col("_tier")
    asked = F.when(F.col("order_type") != "market", limit_slippage).otherwise(slippage) if "order_type" in trades.columns else F.lit(slippage)
    base = F.greatest(asked, by_tier(t, TIER_SLIPPAGE_FLOOR, MIN_SLIPPAGE), F.lit(MIN_SLIPPAGE))
    base = base * F.when(F.col("amplitude") > 0.05, 2.0).otherwise(1.0)
    part = F.coalesce(F.least(F.greatest(F.try_divide(F.col("qty"), F.col("adv")), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    thr = by_tier(t, TIER_THRESHOLD, 0.01)
    impact = F.when(part > thr, F.least(by_tier(t, TIER_IMPACT_BASE, 0.002) * F.pow(part / thr, 1.5), by_tier(t, TIER_CAP, 0.05))).otherwise(0.0)
    stamp_due = sell | (day < F.lit(STAMP_BOTH_SIDES_BEFORE).cast("date"))
    extra = 0.0 if all_in_commission else 1.0
    parts = {
        "commission": F.greatest(value * commission_rate(value, commission, commission_tiers), F.lit(min_commission)),
        "stamp": F.when(stamp_due, value * rate_on(day, STAMP, 0.0005)).otherwise(0.0),
        "transfer": transfer_fee(day, F.col("main_market"), value, F.col("qty")),
        "handling": value * rate_on(day, HANDLING, 0.0000341) * extra,
        "regulator": value * rate_on(day, REGULATOR, 0.00002) * extra,
        "slippage": value * base,
        "impact": value * impact,
    }
    df = df.withColumns(parts)
    total = None
    for p in parts:
        total = F.col(p) if total is None else total + F.col(p)
    return df.withColumn("total", total).withColumnRenamed("_tier", "tier")


COST_PARTS = ("commission", "stamp", "transfer", "handling", "regulator", "slippage", "impact")


def cost_summary(costed: DataFrame) -> DataFrame:
    """Total and share per component, long form."""
    one = costed.agg(*[F.sum(c).alias(c) for c in (*COST_PARTS, "total")])
    arr = F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("amount"), F.try_divide(F.col(c), F.col("total")).alias("share")) for c in COST_PARTS])
    return one.select(F.explode(arr).alias("s")).select("s.*")
