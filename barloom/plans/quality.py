"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import joins as J, quality as Q
from barloom.operators.panel import by_symbol
from barloom.plans.registry import R, cte, lag, query, r, rounded, sql

# Bars with holes: quantities and prices that the checks treat as missing or suspended.
cte(
    "holes",
    f"""SELECT symbol, trade_date, open, CASE WHEN volume>48 THEN NULL ELSE high END AS high, low, CASE WHEN volume<=2 THEN {lag('close')} ELSE close END AS close,
    CASE WHEN volume<=2 THEN 0 WHEN volume BETWEEN 20 AND 21 THEN NULL ELSE volume END AS volume, amount, adj_factor FROM raw""",
    "raw",
)


def holes(v):
    vol = F.col("volume")
    pc = F.lag("close").over(by_symbol())
    df = v.raw.select(
        "symbol", "trade_date", "open", F.when(vol > 48, None).otherwise(F.col("high")).alias("high"), "low",
        F.when(vol <= 2, pc).otherwise(F.col("close")).alias("close"),
        F.when(vol <= 2, 0).when(vol.between(20, 21), None).otherwise(vol).alias("volume"), "amount", "adj_factor",
    )
    return df


_LONG = " UNION ALL ".join(f"SELECT symbol, trade_date, '{c}' AS col, {c} IS NOT NULL AS ok FROM holes" for c in Q.OHLCV)
cte("nr0", f"SELECT *, CASE WHEN lag(ok) OVER (PARTITION BY symbol, col ORDER BY trade_date)=ok THEN 0 ELSE 1 END AS nw FROM ({_LONG})", "holes")
cte("nr1", "SELECT *, sum(nw) OVER (PARTITION BY symbol, col ORDER BY trade_date) AS run FROM nr0", "nr0")
cte("nr2", "SELECT symbol, col, run, ok, count(*) AS n FROM nr1 GROUP BY ALL", "nr1")
cte(
    "nruns",
    "SELECT symbol, col, CAST(sum(n) AS BIGINT) AS n_rows, coalesce(sum(n) FILTER (ok),0)/sum(n) AS ratio, CAST(coalesce(max(n) FILTER (ok),0) AS BIGINT) AS longest_run, CAST(coalesce(max(n) FILTER (NOT ok),0) AS BIGINT) AS longest_gap FROM nr2 GROUP BY 1,2",
    "nr2",
)
cte("nfind", "SELECT *, CASE WHEN NOT (ratio<0.95 OR longest_run<30) THEN 'ok' WHEN longest_gap<=5 AND 1-ratio<=0.10 THEN 'fillable' ELSE 'skip' END AS finding FROM nruns", "nruns")


@query("q02_null_runs", sql("nfind", f'SELECT symbol, col AS "column", n_rows, {R("ratio")} AS ratio, longest_run, longest_gap, finding FROM nfind'))
def _(v):
    return rounded(Q.null_findings(Q.null_runs(holes(v))), "ratio")


cte("fl0", f"SELECT *, coalesce(volume,0)<=0 AND coalesce(abs(close-{lag('close')})<=1e-9,false) AS c, coalesce(volume,0)<=0 AS z, coalesce(volume,0)<=0 AND coalesce(abs(close-{lag('close')})>1e-9,false) AS mv, coalesce(abs(adj_factor/{lag('adj_factor')}-1)>0.03,false) AS aj, coalesce(row_number() OVER (PARTITION BY symbol ORDER BY trade_date)<=6 AND abs(close/{lag('close')}-1)>0.3,false) AS ej FROM holes", "holes")
cte("fl1", f"SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY trade_date) AS run FROM (SELECT *, CASE WHEN {lag('c')}=c THEN 0 ELSE 1 END AS nw FROM fl0)", "fl0")
cte("fl2", "SELECT *, c AND count(*) OVER (PARTITION BY symbol, run)>=3 AS suspended FROM fl1", "fl1")
cte(
    "pre",
    """SELECT *, n_rows<60 AS sh FROM (SELECT symbol, count(*) AS n_rows, count(*) FILTER (z) AS zero_days, count(*) FILTER (mv) AS moves_on_zero, count(*) FILTER (suspended) AS suspended_days,
    count(*) FILTER (aj) AS factor_jumps, count(*) FILTER (ej) AS early_jumps FROM fl2 GROUP BY 1)
    JOIN (SELECT symbol, count(*) FILTER (finding='skip') AS ns, count(*) FILTER (finding='fillable') AS nf FROM nfind GROUP BY 1) USING (symbol)""",
    "fl2",
    "nfind",
)
cte(
    "prs",
    """SELECT *, CASE WHEN sh OR (ns>0 OR zero_days/n_rows>=1 OR moves_on_zero>0) THEN 'SKIP' WHEN nf>0 THEN 'NEED_FILL'
    WHEN (zero_days/n_rows<1 AND zero_days/n_rows>0.05) OR suspended_days/n_rows>0.2 OR factor_jumps>0 OR early_jumps>0 THEN 'LOW_CONFIDENCE' ELSE 'OK' END AS status,
    concat_ws(',', CASE WHEN sh THEN 'TOO_FEW_ROWS' END, CASE WHEN NOT sh AND ns>0 THEN 'NAN_TOO_HIGH' END, CASE WHEN NOT sh AND nf>0 THEN 'NAN_FILLABLE' END, CASE WHEN NOT sh AND zero_days/n_rows>=1 THEN 'ZERO_VOLUME_ALL' END,
    CASE WHEN NOT sh AND zero_days/n_rows<1 AND zero_days/n_rows>0.05 THEN 'ZERO_VOLUME_RATIO_HIGH' END, CASE WHEN NOT sh AND moves_on_zero>0 THEN 'ZERO_VOLUME_PRICE_MOVE' END,
    CASE WHEN NOT sh AND suspended_days/n_rows>0.2 THEN 'SUSPENSION_RATIO_HIGH' END, CASE WHEN NOT sh AND factor_jumps>0 THEN 'ADJ_FACTOR_JUMP' END, CASE WHEN NOT sh AND early_jumps>0 THEN 'IPO_EARLY_VOLATILITY' END) AS reasons FROM pre""",
    "pre",
)
_PC = "symbol, n_rows, zero_days, moves_on_zero, suspended_days, factor_jumps, early_jumps"


@query("q07_precheck", sql("prs", f"SELECT {_PC}, status, reasons FROM prs"))
def _(v):
    return Q.precheck(holes(v))


@query("q03_zero_volume", sql("pre", f"SELECT symbol, zero_days, moves_on_zero, {R('zero_days/n_rows')} AS ratio FROM pre"))
def _(v):
    return Q.precheck(holes(v)).select("symbol", "zero_days", "moves_on_zero", r(F.col("zero_days") / F.col("n_rows")).alias("ratio"))


@query("q04_flat_runs", sql("fl2", "SELECT symbol, trade_date FROM fl2 WHERE suspended"))
def _(v):
    return Q.flat_runs(holes(v)).where("suspended").select("symbol", "trade_date")


@query("q04_calendar_suspension", sql("susp", f"SELECT symbol, {R('missing_days/span_days')} AS suspension_ratio, CASE WHEN confirmed_days/span_days>0.2 THEN 'SUSPENSION_RATIO_HIGH_CAL' WHEN missing_days/span_days>0.2 THEN 'UNDER_COLLECTION_SUSPECTED' ELSE '' END AS finding FROM susp"))
def _(v):
    s = J.suspension_stats(v.raw, v.raw, v.raw.where("year(trade_date) = 1997"))
    p = Q.precheck(v.raw, confirmed=s)
    hit = lambda n: F.when(F.col("reasons").contains(n), n)
    return p.select("symbol", r("suspension_ratio").alias("suspension_ratio"), F.coalesce(hit("SUSPENSION_RATIO_HIGH_CAL"), hit("UNDER_COLLECTION_SUSPECTED"), F.lit("")).alias("finding"))


@query("q05_factor_jumps", sql("pre", "SELECT symbol, factor_jumps FROM pre WHERE factor_jumps>0"))
def _(v):
    return Q.precheck(holes(v)).where("factor_jumps > 0").select("symbol", "factor_jumps")


@query("q06_early_volatility", sql("pre", "SELECT symbol, early_jumps FROM pre WHERE early_jumps>0"))
def _(v):
    return Q.precheck(holes(v)).where("early_jumps > 0").select("symbol", "early_jumps")


@query("q13_precheck_summary", sql("prs", "SELECT status, count(*) AS n FROM prs GROUP BY 1"))
def _(v):
    return Q.precheck(holes(v)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_W = "PARTITION BY symbol ORDER BY trade_date"
_FF = ", ".join(f"coalesce({c}, last_value({c} IGNORE NULLS) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) AS {c}" for c in ("high", "volume"))
_BF = ", ".join(f"coalesce({c}, first_value({c} IGNORE NULLS) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) AS {c}" for c in ("high", "volume"))


@query("q08_bounded_fill", sql("holes", f"SELECT symbol, trade_date, {_BF} FROM (SELECT symbol, trade_date, {_FF} FROM holes)"))
def _(v):
    return Q.bounded_fill(holes(v).select("symbol", "trade_date", "high", "volume"), ["high", "volume"])


@query(
    "q09_contract_violations",
    """WITH t AS (SELECT CASE WHEN o_orderpriority='5-LOW' THEN NULL ELSE 'C' || o_custkey END AS code, CASE WHEN o_orderstatus='P' THEN NULL ELSE o_orderstatus END AS name,
    CASE WHEN o_orderpriority='1-URGENT' THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS last_price, o_orderkey FROM orders)
    SELECT CAST(o_orderkey AS VARCHAR) AS key, 'code' AS "column", 'null' AS problem FROM t WHERE code IS NULL UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'name', 'null' FROM t WHERE name IS NULL
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'last_price', 'not double' FROM t WHERE last_price='n/a'""",
)
def _(v):
    o = v.table("orders").select(
        "o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", None).otherwise(F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).alias("code"),
        F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_orderstatus")).alias("name"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("last_price"),
    )
    return Q.violations(o, Q.CONTRACTS["fund_flow"], "o_orderkey")


@query("q10_price_anomalies", sql("holes", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS nulls, {f'count(*) FILTER ({c}<=0)' if c != 'volume' else '0::BIGINT'} AS non_positive, {f'count(*) FILTER ({c}>10000)' if c != 'volume' else '0::BIGINT'} AS extreme,
    count(*) FILTER ({c} IS NULL)/count(*)<=0.1 AS complete FROM holes""" for c in ("high", "close", "volume"))))
def _(v):
    return Q.anomalies(holes(v), ["high", "close"], ["close", "volume"])




@query("q11_daily_suite", sql("holes", f"""SELECT 'coverage' AS "check", CASE WHEN count(*)>=3000 THEN 'pass' ELSE 'warn' END AS status, count(*)*1e0 AS metric, 3000e0 AS threshold FROM holes
    UNION ALL SELECT 'null_rate:high', CASE WHEN 100e0*count(*) FILTER (high IS NULL)/count(*)<=1 THEN 'pass' ELSE 'warn' END, {R('100e0*count(*) FILTER (high IS NULL)/count(*)')}, 1e0 FROM holes
    UNION ALL SELECT 'null_rate:volume', CASE WHEN 100e0*count(*) FILTER (volume IS NULL)/count(*)<=1 THEN 'pass' ELSE 'warn' END, {R('100e0*count(*) FILTER (volume IS NULL)/count(*)')}, 1e0 FROM holes
    UNION ALL SELECT 'score_distribution', CASE WHEN 100e0*count(DISTINCT close)/count(close)>=1 THEN 'pass' ELSE 'warn' END, {R('100e0*count(DISTINCT close)/count(close)')}, 1e0 FROM holes"""))
def _(v):
    return rounded(Q.daily_suite(holes(v), ["high", "volume"], "close", 3000, 1.0), "metric")


@query("a08_coverage_stats", sql("holes", f"SELECT trade_date, count(*) AS n, {R('avg(CASE WHEN high IS NULL THEN 1e0 ELSE 0e0 END)')} AS null_rate, count(DISTINCT close) AS n_distinct, {R('avg(close)', 4)} AS mean, {R('stddev_samp(close)', 4)} AS std FROM holes GROUP BY 1"))
def _(v):
    g = holes(v).groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg(F.col("high").isNull().cast("double"))).alias("null_rate"), F.count_distinct("close").alias("n_distinct"),
        r(F.avg("close"), 4).alias("mean"), r(F.stddev_samp("close"), 4).alias("std"),
    )
    return g


@query("q12_confidence", sql("fl2", f"SELECT symbol, trade_date, {R('CASE WHEN z THEN amount*0.5e0 ELSE amount END', 2)} AS score FROM fl2"))
def _(v):
    df = holes(v).withColumn("score", F.col("amount"))
    out = Q.consume_confidence(df, F.coalesce("volume", F.lit(0)) <= 0, ["score"])
    return out.select("symbol", "trade_date", r("score", 2).alias("score"))


cte(
    "deg",
    """SELECT symbol, trade_date, i, n, CAST(CASE WHEN n<560 THEN least(560, greatest(3, n//2)) ELSE 560 END AS INT) AS u, list(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS 559 PRECEDING) AS a FROM (
    SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM adj)""",
    "adj",
)


@query("w50_degraded_means", sql("deg", f"SELECT symbol, trade_date, CASE WHEN len(a)>=u THEN {R('list_avg(a[greatest(len(a)-u+1,1):])', 4)} END AS ma_560, n<560 AND i+1>=least(560, greatest(3, n//2)) AS low_confidence FROM deg"))
def _(v):
    df = Q.degraded_means(v.adj, [560])
    return df.select("symbol", "trade_date", r("ma_560", 4).alias("ma_560"), "low_confidence")
