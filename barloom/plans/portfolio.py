"""Position sizing and cap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import portfolio as P, signals as S
from barloom.operators.panel import last_rows
from barloom.plans.registry import R, cte, query, r, rounded, sql

cte(
    "sz",
    """SELECT s.symbol, i.l1 AS industry, level, risk_level, macd_trend, score, close, stop_loss, amount, CASE WHEN volume>40 THEN -0.5e0 WHEN volume<5 THEN 0.2e0 END AS adj,
    CASE WHEN close>stop_loss THEN atr*3/(close-stop_loss) END AS rrr FROM (SELECT * FROM sigf QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC)=1) s JOIN industry i ON s.symbol=i.symbol""",
    "sigf",
    "industry",
)
cte(
    "sz1",
    """SELECT *, CASE level WHEN 'A' THEN 0.30e0 WHEN 'B' THEN 0.15e0 WHEN 'C' THEN 0.05e0 WHEN 'D' THEN 0e0 ELSE 0.03e0 END AS lb, greatest(0,least(100,score))/100e0 AS sf,
    CASE risk_level WHEN 'LOW' THEN 0.85e0 WHEN 'HIGH' THEN 0e0 ELSE 0.5e0 END AS rm, CASE macd_trend WHEN 'SUPER_STRONG' THEN 1e0 WHEN 'STRONG' THEN 0.85e0 WHEN 'WEAK' THEN 0.40e0 ELSE 0e0 END AS tm,
    CASE WHEN coalesce(rrr,0)<=0 THEN 1e0 WHEN rrr<=1 THEN 0.7e0 ELSE greatest(0.5e0,least(1.5e0,0.8e0+greatest((0.55e0*rrr-0.45e0)/rrr,0)*0.25e0*0.7e0)) END AS km,
    CASE WHEN stop_loss>0 AND stop_loss<close AND (close-stop_loss)/(1.5e0*close)>0.001 THEN greatest(0,least(0.33e0,0.02e0/((close-stop_loss)/(1.5e0*close)))) ELSE 0.33e0 END AS cap FROM sz""",
    "sz",
)
cte("sz2", "SELECT *, CASE WHEN risk_level='HIGH' OR tm<=0 THEN 0e0 ELSE greatest(0,least(0.33e0,lb*sf*rm*tm*km*(1+coalesce(adj,0)))) END AS pos FROM sz1", "sz1")


def inputs(v):
    s = S.signals(v.histories)
    s = last_rows(s.select("symbol", "trade_date", "level", "risk_level", "macd_trend", "score", "close", "stop_loss", "atr", "amount", "volume"))
    s = s.withColumn("position_adjust", F.when(F.col("volume") > 40, -0.5).when(F.col("volume") < 5, 0.2))
    s = s.withColumn("exit_rrr", F.when(F.col("close") > F.col("stop_loss"), F.col("atr") * 3 / (F.col("close") - F.col("stop_loss"))))
    return s.join(v.industry.select("symbol", F.col("l1").alias("industry")), "symbol")


@query("x34_position_sizing", sql("sz2", f"SELECT symbol, {R('round(pos,4)', 4)} AS position, {R('cap')} AS vol_cap FROM sz2"))
def _(v):
    df = P.size_positions(inputs(v))
    return df.select("symbol", r("position", 4).alias("position"), r("vol_cap").alias("vol_cap"))


# Caps act on a book of raw weights: balance shares against each symbol's last day amount.
cte("cb", "SELECT i.symbol, l1 AS industry, acctbal AS score, greatest(acctbal,0)/2e4 AS position, amount FROM industry i JOIN (SELECT symbol, arg_max(amount, trade_date) AS amount FROM raw GROUP BY 1) r USING (symbol)", "industry", "raw")
cte("cb1", "SELECT *, CASE WHEN position*1e6/amount>0.01 THEN 0.002e0*pow(position*1e6/amount/0.01e0,1.5e0) ELSE 0 END AS impact FROM cb", "cb")
cte("cb2", "SELECT * REPLACE (CASE WHEN impact>0.02 THEN least(0.01e0*pow(0.02e0/0.002e0,1/1.5e0)*amount/1e6,position) ELSE position END AS position) FROM cb1", "cb1")
cte("cb3", "SELECT * REPLACE (CASE WHEN sum(position) OVER (PARTITION BY industry)<=0.3 THEN position WHEN row_number() OVER (PARTITION BY industry ORDER BY score DESC, symbol)=1 THEN least(position,0.3e0) ELSE 0e0 END AS position) FROM cb2", "cb2")
cte("cb4", "SELECT * REPLACE (CASE WHEN sum(position) OVER ()>0.5 THEN position*0.5e0/sum(position) OVER () ELSE position END AS position) FROM cb3", "cb3")


def cap_book(v):
    a = v.raw.groupBy("symbol").agg(F.max_by("amount", "trade_date").alias("amount"))
    b = v.industry.select("symbol", F.col("l1").alias("industry"), F.col("acctbal").alias("score"), (F.greatest("acctbal", F.lit(0.0)) / 2e4).alias("position"))
    return b.join(a, "symbol")


@query("x35_liquidity_impact_cap", sql("cb2", f"SELECT symbol, {R('impact')} AS impact, {R('position')} AS position FROM cb2"))
def _(v):
    return rounded(P.impact_cap(cap_book(v)).select("symbol", "impact", "position"), "impact", "position")


@query("x36_industry_cap", sql("cb", f"SELECT symbol, {R('CASE WHEN sum(position) OVER (PARTITION BY industry)<=0.3 THEN position WHEN row_number() OVER (PARTITION BY industry ORDER BY score DESC, symbol)=1 THEN least(position,0.3e0) ELSE 0e0 END')} AS position FROM cb"))
def _(v):
    return rounded(P.industry_cap(cap_book(v)).select("symbol", "position"), "position")


@query("x37_constraint_chain", sql("cb4", f"SELECT symbol, {R('position')} AS position FROM cb4"))
def _(v):
    return rounded(P.constrain(cap_book(v)).select("symbol", "position"), "position")


@query("j16_turnover", sql("wal", f"SELECT {R('sum(abs(target-previous))/2')} AS turnover FROM wal"))
def _(v):
    from barloom.plans.joins import weights

    return rounded(P.turnover(weights(v)), "turnover")


@query("x39_score_weights", sql("sz", f"SELECT symbol, {R('w/sum(w) OVER ()')} AS weight FROM (SELECT symbol, least(1/CASE risk_level WHEN 'LOW' THEN 1.5e0 WHEN 'HIGH' THEN 5e0 ELSE 3e0 END,0.3e0) AS w FROM sz WHERE score>=20)"))
def _(v):
    return rounded(P.score_weights(inputs(v), 20, 0.3).select("symbol", "weight"), "weight")


@query("t04_top_candidates_per_day", sql("sigf", f"SELECT symbol, trade_date, score, rank FROM (SELECT symbol, trade_date, score, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, symbol) AS rank FROM (SELECT symbol, trade_date, {R('score', 4)} AS score FROM sigf)) WHERE rank<=5"))
def _(v):
    df = rounded(S.signals(v.histories).select("symbol", "trade_date", "score"), "score", d=4)
    return P.top_per_day(df, 5)
