"""Report filters, ordering and factor packing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def any_signal(df: DataFrame, flags: Sequence[str], texts: Sequence[str]) -> DataFrame:
    conds = [F.coalesce(F.col(f) == "yes", F.lit(False)) for f in flags] + [F.trim(F.coalesce(F.col(t), F.lit(""))) != "" for t in texts]
    return df.where(reduce(lambda a, b: a | b, conds))


def drop_weak(df: DataFrame, strong_levels: Sequence[str] = ("full_bull", "accelerating")) -> DataFrame:
    """Drop D conclusions and industry laggards that no trend level or factor exempts."""
    pct = lambda c: F.coalesce(F.col(c), F.lit(50.0))
    exempt = F.col("trend_level").isin(*strong_levels) | (pct("momentum_pct") > 80) | (pct("quality_pct") > 80) | (pct("valuation_pct") > 80)
    bad = F.col("conclusion").startswith("D:") | (F.col("conclusion") == "C: no signal")
    return df.where(~F.coalesce(bad, F.lit(False)) & (F.coalesce(exempt, F.lit(False)) | (pct("score_pct") >= 10)))


def ma_breakout(candidates: DataFrame, levels: DataFrame) -> DataFrame:
    """Candidates whose price is above MA10 with MA10 over MA30 or MA30 over MA60."""
    low = F.lit(float("-inf"))
    m10, m30, m60 = F.col("ma_10"), F.coalesce("ma_30", low), F.coalesce("ma_60", low)
    return candidates.select("symbol").distinct().join(levels, "symbol", "left").where(
        (F.col("close") > m10) & ((m10 > m30) | (F.col("ma_30").isNotNull() & (m30 > m60)))
    )


def reorder(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    head = [c for c in wanted if c in df.columns]
    return df.select(*head, *[c for c in df.columns if c not in head])


def fill_missing(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    out = df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})
    return out.na.fill({c: v for c, v in defaults.items() if c in df.columns})


def projected(df: DataFrame, names: dict[str, str], money: Sequence[str], whole: Sequence[str], key: str, order: Column) -> DataFrame:
    """Report columns under their stored names, amounts parsed from text, counts as whole numbers (none is 0),
    and of rows with one key the last by `order`; rows without a key stay, for the gate to name."""
    from barloom.functions.text import money as parsed

    out = df.select(*[F.col(a).alias(b) for a, b in names.items() if a in df.columns], order.alias("_order"))
    out = out.withColumns({c: parsed(F.col(c).cast("string")) for c in money if c in out.columns})
    out = out.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).cast("bigint") for c in whole if c in out.columns})
    rest = [c for c in out.columns if c not in (key, "_order")]
    last = out.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_order", *rest)).alias("_r")).select(key, "_r.*")
    return last.unionByName(out.where(F.col(key).isNull()).select(key, *rest))


def sort_report(df: DataFrame) -> DataFrame:
    link = F.concat(F.lit("https://quote.example.com/"), F.col("symbol").cast("string"))
    return df.withColumn("link", link).orderBy(F.desc("rise_days"), F.desc("volume_days"), "symbol")


def pack_factors(df: DataFrame, factors: Sequence[str]) -> Column:
    return F.to_json(F.map_from_arrays(F.array(*[F.lit(f) for f in factors]), F.array(*[F.col(f).cast("double") for f in factors])))


def unpack_factors(json: Column) -> Column:
    return F.from_json(json, "map<string,double>")


def to_raw_prices(df: DataFrame, factors: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Adjusted report prices back to quoted ones with the factor of the date."""
    j = df.join(factors.select("symbol", "trade_date", "adj_factor"), ["symbol", "trade_date"], "left")
    return j.withColumns({c: F.col(c) / F.coalesce("adj_factor", F.lit(1.0)) for c in cols}).drop("adj_factor")
