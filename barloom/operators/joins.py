"""Point-in-time, interval and existence joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barloom.operators.panel import history


def first_name(sources: Sequence[DataFrame], key: str = "symbol", name: str = "name") -> DataFrame:
    """First non-missing name per key; the position of the source is its priority."""
    tagged = [d.select(key, name, F.lit(i).alias("_p")) for i, d in enumerate(sources)]
    u = reduce(DataFrame.unionByName, tagged).where(F.trim(F.coalesce(name, F.lit(""))) != "")
    return u.groupBy(key).agg(F.min_by(name, F.struct("_p", name)).alias(name))


def consolidate(base: DataFrame, parts: Sequence[DataFrame], key: str = "symbol", order: str | None = None) -> DataFrame:
    """Left-join many tables on one key; each right side keeps its first row per key.

    First is by the column `order`, where a table has it, then by the other columns; it is not
    whichever row came first.  The order column itself isn't joined."""
    out = base
    for p in parts:
        cols = [c for c in p.columns if c not in (key, order)]
        first = F.struct(*([order] if order in p.columns else []), *cols)
        one = p.groupBy(key).agg(F.min_by(F.struct(*cols), first).alias("_s")).select(key, "_s.*")
        out = out.join(one, key, "left")
    return out


def membership(base: DataFrame, members: DataFrame, flag: str, key: str = "symbol") -> DataFrame:
    """yes/no column for being on a list."""
    m = members.select(key).distinct().withColumn("_in", F.lit(True))
    return base.join(m, key, "left").withColumn(flag, F.when(F.col("_in"), "yes").otherwise("no")).drop("_in")


def as_of(facts: DataFrame, when: Column, key: str = "symbol") -> DataFrame:
    """Latest record per key that was public by `when`; undisclosed rows count by record date."""
    seen = F.coalesce(F.col("disclosure_date"), F.col("record_date"))
    cols = [c for c in facts.columns if c not in (key, "record_date")]
    f = facts.where(seen <= when)
    return f.groupBy(key).agg(F.max(F.struct("record_date", *cols)).alias("_s")).select(key, "_s.*")


def as_of_each(probes: DataFrame, facts: DataFrame, at: str, value: Sequence[str], key: str = "symbol") -> DataFrame:
    """Latest known record for every probe row.

    Facts, and the times of the probes, are first reduced to one row per key and day, over
    which the latest record is carried; the probes then meet their day in an equi-join, so a key
    with most of the probes is split like any hot join key.
    A later-published restatement of an older period does not replace a newer one."""
    seen = F.coalesce(F.col("disclosure_date"), F.col("record_date"))
    rec = F.struct("record_date", *value)
    f = facts.where(seen.isNotNull()).select(key, seen.alias("_t"), rec.alias("_r"))
    days = probes.select(key, F.col(at).alias("_t")).distinct()
    known = f.unionByName(days, allowMissingColumns=True).groupBy(key, "_t").agg(F.max("_r").alias("_r"))
    w = W.partitionBy(key).orderBy("_t").rowsBetween(W.unboundedPreceding, 0)  # days of a calendar
    known = known.select(F.col(key).alias("_k"), "_t", F.max("_r").over(w).alias("_v"))
    met = probes.join(known, (F.col(key) == F.col("_k")) & (F.col(at) == F.col("_t")), "left")
    return met.select(*probes.columns, *[F.col(f"_v.{c}").alias(c) for c in ("record_date", *value)])


def merge_signals(bars: DataFrame, signals: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Attach signals to bars: scores default to 0, risk to LOW, the stop carries forward."""
    df = bars.join(signals.select("symbol", "trade_date", *scores, "stop_loss", "risk_level"), ["symbol", "trade_date"], "left")
    df = df.withColumns({s: F.coalesce(F.col(s).cast("double"), F.lit(0.0)) for s in scores})
    return df.withColumn("stop_loss", F.coalesce(F.last("stop_loss", ignorenulls=True).over(history()), F.lit(0.0))).withColumn(
        "risk_level", F.coalesce("risk_level", F.lit("LOW"))
    )


def name_flags(name: Column) -> tuple[Column, Column]:
    """(special treatment, delisting) flags from a security name."""
    n = F.upper(F.replace(F.coalesce(name, F.lit("")), F.lit(" "), F.lit("")))
    return n.contains("ST"), n.contains("退")


def status_intervals(changes: DataFrame, st: Column, dl: Column, date: str = "change_date") -> DataFrame:
    """Name changes to flagged periods [start, end): runs of equal flags, end = next change.
    A symbol has few name changes, so the per-symbol window is small."""
    w = W.partitionBy("symbol").orderBy(date)
    d = changes.groupBy("symbol", date).agg(F.max(st).alias("is_st"), F.max(dl).alias("is_delisting"))
    prev = F.lag(F.struct("is_st", "is_delisting")).over(w)
    d = d.withColumn("_new", prev.isNull() | (prev != F.struct("is_st", "is_delisting"))).where("_new")
    d = d.withColumn("end_date", F.lead(date).over(w)).where("is_st or is_delisting")
    return d.select("symbol", F.col(date).alias("start_date"), "end_date", "is_st", "is_delisting")


def expand_intervals(periods: DataFrame, bars: DataFrame, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Status periods to the trading days they cover."""
    b = bars.select("symbol", "trade_date")
    if lo:
        b = b.where(F.col("trade_date") >= F.lit(lo).cast("date"))
    if hi:
        b = b.where(F.col("trade_date") <= F.lit(hi).cast("date"))
    return b.join(periods, "symbol").where(
        (F.col("trade_date") >= F.col("start_date")) & (F.col("end_date").isNull() | (F.col("trade_date") < F.col("end_date")))
    ).select("symbol", "trade_date", "is_st", "is_delisting")


def day_state(bars: DataFrame, states: DataFrame) -> DataFrame:
    """Status of each bar; days without a row are unflagged."""
    s = states.groupBy("symbol", "trade_date").agg(F.max("is_st").alias("is_st"), F.max("is_delisting").alias("is_delisting"))
    return bars.join(s, ["symbol", "trade_date"], "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(False)) for c in ("is_st", "is_delisting")}
    )


def delisting_window(bars: DataFrame, delisted: DataFrame, reform: str = "2020-12-31", new: int = 15, old: int = 30) -> DataFrame:
    """Last N trading days up to the delisting date; N depends on the date."""
    d = delisted.groupBy("symbol").agg(F.min("delist_date").alias("delist_date"))
    b = bars.select("symbol", "trade_date").join(d, "symbol").where(F.col("trade_date") <= F.col("delist_date"))
    n = F.when(F.col("delist_date") < F.lit(reform).cast("date"), old).otherwise(new)
    w = W.partitionBy("symbol").orderBy(F.desc("trade_date"))
    return b.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).select("symbol", "trade_date", "delist_date")


def listing_age(bars: DataFrame, listed: DataFrame) -> DataFrame:
    """Trading days since the listing date (1 on the first day)."""
    b = bars.select("symbol", "trade_date").join(listed, "symbol").where(F.col("trade_date") >= F.col("ipo_date"))
    return b.withColumn("listing_days", F.row_number().over(W.partitionBy("symbol").orderBy("trade_date")))


def missing_days(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Calendar days between a symbol's first and last bar that it has no bar on."""
    span = bars.groupBy("symbol").agg(F.min("trade_date").alias("_a"), F.max("trade_date").alias("_z"))
    # An equi-joined range: each symbol meets the months it spans, then the days of a month.
    months = span.withColumn("_m", F.explode(F.sequence(F.trunc("_a", "month"), F.trunc("_z", "month"), F.expr("interval 1 month"))))
    cal = calendar.select("trade_date").distinct().withColumn("_m", F.trunc("trade_date", "month"))
    want = months.join(cal, "_m").where(F.col("trade_date").between(F.col("_a"), F.col("_z")))
    return want.select("symbol", "trade_date").join(bars.select("symbol", "trade_date"), ["symbol", "trade_date"], "left_anti")


def suspension_stats(bars: DataFrame, calendar: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """Per symbol: span, missing days and ratio, interior blocks, tail days and, given the
    confirmed suspensions, the split into confirmed and under-collected."""
    cal = calendar.select("trade_date").distinct().withColumn("pos", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("trade_date")))
    have = bars.select("symbol", "trade_date").join(cal, "trade_date")
    last = F.lit(have.agg(F.max("pos")).scalar())
    base = have.groupBy("symbol").agg(F.min("pos").alias("_a"), F.max("pos").alias("_z"), F.count(F.lit(1)).alias("_n"))
    base = base.select(
        "symbol",
        (F.col("_z") - F.col("_a") + 1).alias("span_days"),
        (F.col("_z") - F.col("_a") + 1 - F.col("_n")).alias("missing_days"),
        (last - F.col("_z")).alias("tail_days"),
    )
    gap = F.col("pos") - F.lag("pos").over(W.partitionBy("symbol").orderBy("pos")) - 1
    blocks = have.withColumn("_g", gap).where("_g > 0").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.max("_g").alias("longest_block")
    )
    out = base.join(blocks, "symbol", "left").na.fill(0, ["n_blocks", "longest_block"])
    out = out.withColumn("suspension_ratio", F.col("missing_days") / F.col("span_days"))
    if confirmed is not None:
        c = missing_days(bars, calendar).join(confirmed.select("trade_date").distinct(), "trade_date", "left_semi")
        out = out.join(c.groupBy("symbol").agg(F.count(F.lit(1)).alias("confirmed_days")), "symbol", "left").na.fill(0, ["confirmed_days"])
        out = out.withColumn("under_collected_days", F.col("missing_days") - F.col("confirmed_days"))
        out = out.withColumn("confirmed_ratio", F.col("confirmed_days") / F.col("span_days"))
    return out


def suspects(stats: DataFrame, limit: float) -> DataFrame:
    return stats.where(F.col("suspension_ratio") > limit).orderBy(F.desc("suspension_ratio"), "symbol")
