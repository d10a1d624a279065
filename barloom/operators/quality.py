"""Data-quality checks: prechecks per symbol, contracts, fills and the daily suite."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barloom.operators.panel import by_symbol
from barloom.operators.scaling import reuse

OHLCV = ("open", "high", "low", "close", "volume")


@dataclass(frozen=True)
class PrecheckParams:
    """Fixed values of the window precheck."""

    min_rows: int = 60
    min_ratio: float = 0.95
    min_run: int = 30
    max_zero_volume: float = 0.05
    max_suspension: float = 0.20
    max_jump: float = 0.30
    ipo_days: int = 5
    fillable: float = 0.10
    max_gap: int = 5


def required_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Names missing from the schema; no job runs."""
    return [c for c in required if c not in df.columns]


def null_runs(df: DataFrame, cols: Sequence[str] = OHLCV) -> DataFrame:
    """Per symbol and column: rows, non-null share, longest non-null run and longest gap."""
    long = df.select("symbol", "trade_date", *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        ["symbol", "trade_date"], list(cols), "column", "value"
    )
    w = W.partitionBy("symbol", "column").orderBy("trade_date")
    s = long.withColumn("_ok", F.col("value").isNotNull())
    s = s.withColumn("_new", (F.lag("_ok").over(w).isNull() | (F.lag("_ok").over(w) != F.col("_ok"))).cast("int"))
    s = s.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    r = s.groupBy("symbol", "column", "_run", "_ok").agg(F.count(F.lit(1)).alias("_len"))
    n = lambda c: F.coalesce(c, F.lit(0))
    return r.groupBy("symbol", "column").agg(
        F.sum("_len").alias("n_rows"),
        (n(F.sum(F.when(F.col("_ok"), F.col("_len")))) / F.sum("_len")).alias("ratio"),
        n(F.max(F.when(F.col("_ok"), F.col("_len")))).alias("longest_run"),
        n(F.max(F.when(~F.col("_ok"), F.col("_len")))).alias("longest_gap"),
    )


def null_findings(stats: DataFrame, p: PrecheckParams = PrecheckParams()) -> DataFrame:
    """fillable / skip / ok per symbol and column."""
    bad = (F.col("ratio") < p.min_ratio) | (F.col("longest_run") < p.min_run)
    fill = (F.col("longest_gap") <= p.max_gap) & (1 - F.col("ratio") <= p.fillable)
    return stats.withColumn("finding", F.when(~bad, "ok").when(fill, "fillable").otherwise("skip"))


def flat_runs(df: DataFrame) -> DataFrame:
    """Mark rows in runs of at least three zero-volume rows with an unchanged close."""
    w = by_symbol()
    df = df.withColumn("_c", (F.coalesce("volume", F.lit(0)) <= 0) & F.coalesce(F.abs(F.col("close") - F.lag("close").over(w)) <= 1e-9, F.lit(False)))
    df = df.withColumn("_new", (F.lag("_c").over(w).isNull() | (F.lag("_c").over(w) != F.col("_c"))).cast("int"))
    df = df.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    n = F.count(F.lit(1)).over(W.partitionBy("symbol", "_run"))
    return df.withColumn("suspended", F.col("_c") & (n >= 3)).drop("_c", "_new", "_run")


def precheck(df: DataFrame, p: PrecheckParams = PrecheckParams(), mode: str = "RELAX", confirmed: DataFrame | None = None) -> DataFrame:
    """Status and reasons per symbol from all checks.

    `confirmed` (symbol, suspension_ratio, confirmed_ratio) switches the suspension check to
    the calendar form."""
    w = by_symbol()
    pc, pf = F.lag("close").over(w), F.lag("adj_factor").over(w)
    d = flat_runs(df).withColumns(
        {
            "_z": F.coalesce("volume", F.lit(0)) <= 0,
            "_mv": (F.coalesce("volume", F.lit(0)) <= 0) & F.coalesce(F.abs(F.col("close") - pc) > 1e-9, F.lit(False)),
            "_aj": F.coalesce(F.abs(F.col("adj_factor") / pf - 1) > 0.03, F.lit(False)),
            "_early": F.coalesce((F.row_number().over(w) <= p.ipo_days + 1) & (F.abs(F.col("close") / pc - 1) > p.max_jump), F.lit(False)),
        }
    )
    cnt = lambda c: F.sum(F.col(c).cast("int"))
    g = d.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), cnt("_z").alias("zero_days"), cnt("_mv").alias("moves_on_zero"), cnt("suspended").alias("suspended_days"),
        cnt("_aj").alias("factor_jumps"), cnt("_early").alias("early_jumps"),
    )
    nf = null_findings(null_runs(df), p).groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.when(F.col("finding") == "skip", F.col("column")))).alias("_skip"),
        F.sort_array(F.collect_list(F.when(F.col("finding") == "fillable", F.col("column")))).alias("_fill"),
    )  # at most five columns per symbol
    g = g.join(nf, "symbol")
    if confirmed is not None:
        g = g.join(confirmed.select("symbol", "suspension_ratio", "confirmed_ratio"), "symbol", "left")
        susp_hard = F.coalesce(F.col("confirmed_ratio") > p.max_suspension, F.lit(False))
        susp_soft = F.coalesce((F.col("confirmed_ratio") <= p.max_suspension) & (F.col("suspension_ratio") > p.max_suspension), F.lit(False))
        susp = (("SUSPENSION_RATIO_HIGH_CAL", "skip", susp_hard), ("UNDER_COLLECTION_SUSPECTED", "low", susp_soft))
    else:
        susp = (("SUSPENSION_RATIO_HIGH", "low", F.col("suspended_days") / F.col("n_rows") > p.max_suspension),)
    zr = F.col("zero_days") / F.col("n_rows")
    short = F.col("n_rows") < p.min_rows
    checks = [
        ("TOO_FEW_ROWS", "skip", short),
        ("NAN_TOO_HIGH", "skip", ~short & (F.size("_skip") > 0)),
        ("NAN_FILLABLE", "fill", ~short & (F.size("_fill") > 0)),
        ("ZERO_VOLUME_ALL", "skip", ~short & (zr >= 1)),
        ("ZERO_VOLUME_RATIO_HIGH", "low", ~short & (zr < 1) & (zr > p.max_zero_volume)),
        ("ZERO_VOLUME_PRICE_MOVE", "skip", ~short & (F.col("moves_on_zero") > 0)),
        *[(n, s, ~short & c) for n, s, c in susp],
        ("ADJ_FACTOR_JUMP", "low", ~short & (F.col("factor_jumps") > 0)),
        ("IPO_EARLY_VOLATILITY", "low", ~short & (F.col("early_jumps") > 0)),
    ]
    any_of = lambda kind: reduce(lambda a, b: a | b, [c for _, s, c in checks if s == kind], F.lit(False))
    status = F.when(any_of("skip"), "SKIP")
    if mode == "OFF":
        status = F.lit("OK")
    elif mode == "STRICT":
        status = status.when(any_of("fill") | any_of("low"), "SKIP").otherwise("OK")
    else:
        status = status.when(any_of("fill"), "NEED_FILL").when(any_of("low"), "LOW_CONFIDENCE").otherwise("OK")
    reasons = F.concat_ws(",", *[F.when(c, n) for n, _, c in checks]) if mode != "OFF" else F.lit("")
    return g.withColumn("status", status).withColumn("reasons", reasons).drop("_skip", "_fill")


def bounded_fill(df: DataFrame, cols: Sequence[str], limit: int = 5) -> DataFrame:
    """Forward fill at most `limit` rows, then backward fill at most `limit` rows."""
    w = by_symbol()
    fwd = {c: F.coalesce(F.col(c), F.last(c, True).over(w.rowsBetween(-limit, -1))) for c in cols}
    out = df.withColumns(fwd)
    return out.withColumns({c: F.coalesce(F.col(c), F.first(c, True).over(w.rowsBetween(1, limit))) for c in cols})


@dataclass(frozen=True)
class Rule:
    """One column of a contract."""

    name: str
    kind: str = "string"
    nullable: bool = True


# The six table contracts.
CONTRACTS: dict[str, tuple[Rule, ...]] = {
    "stock_basic": (Rule("code", nullable=False), Rule("name", nullable=False), Rule("industry")),
    "stock_price": (Rule("code", nullable=False), Rule("last_price", "double")),
    "fund_flow": (Rule("code", nullable=False), Rule("name", nullable=False), Rule("last_price", "double")),
    "industry_board": (Rule("board_name", nullable=False), Rule("board_code", nullable=False), Rule("pct_change", "double")),
    "main_cost": (Rule("code", nullable=False), Rule("cost", "double"), Rule("cost_diff", "double"), Rule("cost_class"), Rule("control_strength")),
    "final_report": (
        Rule("code", nullable=False), Rule("name", nullable=False), Rule("industry"), Rule("industry_signal"), Rule("last_price", "double"),
        Rule("strong"), Rule("price_volume"), Rule("rise_days", "bigint"), Rule("volume_days", "bigint"), Rule("trend"), Rule("link"),
    ),
}


def violations(df: DataFrame, contract: Sequence[Rule], key: str) -> DataFrame:
    """All contract breaks at once: (key, column, problem); absent columns give one row."""
    missing = [r for r in contract if r.name not in df.columns]
    checks = []
    for rule in contract:
        if rule in missing:
            continue
        c = F.col(rule.name)
        problem = F.lit(None).cast("string")
        if rule.kind != "string":
            problem = F.when(c.isNotNull() & c.cast("string").try_cast(rule.kind).isNull(), f"not {rule.kind}")
        if not rule.nullable:
            problem = F.coalesce(problem, F.when(c.isNull(), "null"))
        checks.append(F.struct(F.lit(rule.name).alias("column"), problem.alias("problem")))
    out = df.select(F.col(key).cast("string").alias("key"), F.explode(F.array(*checks)).alias("s")).select("key", "s.*").where("problem is not null")
    if missing:
        lost = df.sparkSession.createDataFrame([(None, r.name, "missing column") for r in missing], "key string, column string, problem string")
        out = out.unionByName(lost)
    return out


def anomalies(df: DataFrame, prices: Sequence[str], critical: Sequence[str], null_limit: float = 0.1) -> DataFrame:
    """Counts of null, non-positive and extreme prices plus completeness, one row per column."""
    n = F.count(F.lit(1))
    aggs = []
    for c in dict.fromkeys([*prices, *critical]):
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                n.alias("n_rows"),
                F.count(F.when(F.col(c).isNull(), 1)).alias("nulls"),
                (F.count(F.when(F.col(c) <= 0, 1)) if c in prices else F.lit(0).cast("bigint")).alias("non_positive"),
                (F.count(F.when(F.col(c) > 10_000, 1)) if c in prices else F.lit(0).cast("bigint")).alias("extreme"),
            ).alias(f"_{c}")
        )
    one = df.agg(*aggs)
    rows = one.select(F.explode(F.array(*[F.col(f"_{c}") for c in dict.fromkeys([*prices, *critical])])).alias("s")).select("s.*")
    return rows.withColumn("complete", F.coalesce(F.col("nulls") / F.nullif(F.col("n_rows"), F.lit(0)) <= null_limit, F.lit(False)))


def daily_suite(report: DataFrame, key_columns: Sequence[str], score: str, expected: int, max_null: float = 30.0) -> DataFrame:
    """Log rows (check, status, metric, threshold): coverage, null rates and score spread."""
    aggs = [F.count(F.lit(1)).cast("double").alias("_n"), F.count(score).alias("_c"), F.count_distinct(score).alias("_d")]
    aggs += [(F.avg(F.col(c).isNull().cast("double")) * 100).alias(f"_null_{c}") for c in key_columns]
    one = report.agg(*aggs)
    uniq = F.coalesce(F.try_divide(F.col("_d") * 100.0, F.col("_c")), F.lit(0.0))
    row = lambda name, ok, metric, thr: F.struct(F.lit(name).alias("check"), F.when(ok, "pass").otherwise("warn").alias("status"), metric.alias("metric"), F.lit(float(thr)).alias("threshold"))
    rows = [row("coverage", F.col("_n") >= expected, F.col("_n"), expected)]
    rows += [row(f"null_rate:{c}", F.col(f"_null_{c}") <= max_null, F.col(f"_null_{c}"), max_null) for c in key_columns]
    rows.append(row("score_distribution", uniq >= 1.0, uniq, 1.0))
    return one.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def consume_confidence(df: DataFrame, flag: Column, scores: Sequence[str], action: str = "weight", weight: float = 0.5) -> DataFrame:
    """Low-confidence rows lose their score (skip) or part of it (weight)."""
    k = 0.0 if action == "skip" else weight
    return df.withColumns({s: F.when(flag, F.col(s) * k).otherwise(F.col(s)) for s in scores})


def degraded_means(df: DataFrame, periods: Sequence[int], mode: str = "RELAX", min_periods: int = 3) -> DataFrame:
    """Moving averages whose window shrinks when a symbol is too short for the period.

    The length of a window is data, so its sum is the difference of two running sums: the row's own, and
    that of the row where the window begins, found by an equi-join on the row's number.  Every row is read
    once a period, whatever the period.  Missing closes count neither in sums nor in lengths."""
    n = F.count(F.lit(1)).over(W.partitionBy("symbol"))  # bounded by the calendar
    far = by_symbol().rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumns({"_n": n, "_i": F.row_number().over(by_symbol()), "_s": F.coalesce(F.sum("close").over(far), F.lit(0.0)), "_c": F.count("close").over(far)})
    df = reuse(df)
    start = df.select("symbol", F.col("_i").alias("_b"), F.col("_s").alias("_s0"), F.col("_c").alias("_c0"))
    low = F.lit(False)
    for p in periods:
        reduced = F.greatest(F.lit(1), F.least(F.lit(p), F.greatest(F.lit(min_periods), F.floor(F.col("_n") / 2)))).cast("int")
        short = F.col("_n") < p
        used = F.when(short & F.lit(mode == "RELAX"), reduced).otherwise(p).cast("int")
        df = df.withColumn("_b", F.col("_i") - used).join(start, ["symbol", "_b"], "left")
        mean = F.try_divide(F.col("_s") - F.coalesce("_s0", F.lit(0.0)), F.col("_c") - F.coalesce("_c0", F.lit(0)))
        df = df.withColumn(f"ma_{p}", F.when(F.col("_b") >= 0, mean)).drop("_b", "_s0", "_c0")
        if mode == "RELAX":
            low = low | (short & (F.col("_i") >= reduced))
        elif mode == "SKIP":
            low = low | short
    return df.withColumn("low_confidence", low).drop("_n", "_i", "_s", "_c")
