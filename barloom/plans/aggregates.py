"""Flow, event, sentiment and valuation aggregate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import cross_section as X, market as M
from barloom.plans.registry import R, cte, query, r, rounded, sql, zsql


@query("a01_ranking_list_stats", sql("daily_flow", f"SELECT symbol, {R('sum(net)', 2)} AS total, {R('avg(net)', 2)} AS mean, count(*) AS appearances FROM daily_flow WHERE trade_date IN (SELECT DISTINCT trade_date FROM daily_flow ORDER BY 1 DESC LIMIT 60) GROUP BY 1"))
def _(v):
    return rounded(M.appearance_stats(v.daily_flow, "net", 60), "total", "mean", d=2)


@query("a02_flow_stats", sql("daily_flow raw", f"""SELECT symbol, {R('sum(net)', 2)} AS total, {R('avg(net)', 2)} AS mean, count(*) AS n, {R('avg(volume)', 4)} AS mean_holding, {R('avg(net)*count(*)', 2)} AS trend
    FROM daily_flow JOIN raw USING (symbol, trade_date) WHERE trade_date IN (SELECT DISTINCT trade_date FROM daily_flow ORDER BY 1 DESC LIMIT 60) GROUP BY 1"""))
def _(v):
    df = M.flow_stats(v.daily_flow.join(v.raw.select("symbol", "trade_date", "volume"), ["symbol", "trade_date"]), "net", "volume", 60)
    return rounded(rounded(df, "total", "mean", "trend", d=2), "mean_holding", d=4)


POS, NEG = ("heon", "erst", "inan"), ("thwh", "reau", "ouon")
_P = "+".join(f"contains(text,'{w}')::INT" for w in POS)
_N = "+".join(f"contains(text,'{w}')::INT" for w in NEG)
cte("snt", f"SELECT doc_id, source, coalesce((({_P})-({_N}))/greatest(({_P})+({_N}),1),0) AS s FROM documents")


@query("c27_title_sentiment", sql("snt", f"SELECT doc_id, {R('s')} AS sentiment FROM snt"))
def _(v):
    return v.table("documents").select("doc_id", r(M.title_sentiment(F.col("text"), POS, NEG)).alias("sentiment"))


@query("a03_news_sentiment", sql("snt", f"SELECT source AS symbol, {R('sum(s)')} AS score, count(*) FILTER (s>0) AS positive, count(*) FILTER (s<0) AS negative, count(*) AS total FROM snt GROUP BY 1"))
def _(v):
    news = v.table("documents").select(F.col("source").alias("symbol"), "text")
    return rounded(M.sentiment_stats(news, "text", positive=POS, negative=NEG), "score")


_AMT = "CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"
cte("ev_hold", f"SELECT user_id AS symbol, {_AMT.format(x='CASE WHEN event_type=' + chr(39) + 'signup' + chr(39) + ' THEN value ELSE -value END')} AS amount FROM events WHERE event_type IN ('signup','error') GROUP BY 1")
cte("ev_rep", f"SELECT user_id AS symbol, {_AMT.format(x='value')} AS amount FROM events WHERE event_type='purchase' GROUP BY 1")
cte("ev_div", f"SELECT user_id AS symbol, {_AMT.format(x='value')} AS amount FROM events WHERE event_type='view' GROUP BY 1")


def event_sources(v):
    e = v.table("events").withColumn("symbol", F.col("user_id")).withColumn("amt", F.col("value").cast("decimal(18,2)"))
    tot = lambda df, c: df.groupBy("symbol").agg(F.sum(c).cast("double").alias("amount"))
    hold = tot(e.where("event_type in ('signup','error')"), M.signed_flow(F.col("event_type"), ["signup"], F.col("amt")))
    return [(tot(e.where("event_type = 'purchase'"), F.col("amt")), False), (hold, True), (tot(e.where("event_type = 'view'"), F.col("amt")), False)]


@query("a05_event_amounts", sql("ev_hold ev_rep ev_div", "SELECT symbol, amount, 'repurchase' AS kind FROM ev_rep UNION ALL SELECT symbol, amount, 'holder' FROM ev_hold UNION ALL SELECT symbol, amount, 'dividend' FROM ev_div"))
def _(v):
    rep, hold, div = (d for d, _ in event_sources(v))
    tag = lambda d, k: d.select("symbol", "amount", F.lit(k).alias("kind"))
    return tag(rep, "repurchase").unionByName(tag(hold, "holder")).unionByName(tag(div, "dividend"))


cte(
    "evs",
    """SELECT symbol, e/max(abs(e)) OVER () AS event_score FROM (SELECT symbol, sum(x) AS e FROM (SELECT symbol, amount/(SELECT max(amount)+1 FROM ev_rep) AS x FROM ev_rep
    UNION ALL SELECT symbol, amount/(SELECT max(abs(amount))+1 FROM ev_hold) FROM ev_hold UNION ALL SELECT symbol, amount/(SELECT max(amount)+1 FROM ev_div) FROM ev_div) GROUP BY 1)""",
    "ev_hold",
    "ev_rep",
    "ev_div",
)


@query("a04_event_score", sql("evs", f"SELECT symbol, {R('event_score')} AS event_score FROM evs"))
def _(v):
    return rounded(M.event_score(event_sources(v)), "event_score")


cte("evi", "SELECT e.symbol, c_mktsegment AS industry, event_score FROM evs e JOIN customer ON e.symbol=c_custkey", "evs")


@query("x11_event_factor", sql("evi", f"SELECT symbol, {R(zsql('event_score', 'industry'))} AS event_driven FROM evi"))
def _(v):
    df = M.event_score(event_sources(v)).join(v.table("customer").select(F.col("c_custkey").alias("symbol"), F.col("c_mktsegment").alias("industry")), "symbol")
    return rounded(X.zscore(df, ["industry"], {"event_driven": "event_score"}).select("symbol", "event_driven"), "event_driven")


_H = lambda c: f"sum(top_price) FILTER (top_price>0 AND {c}>0)/nullif(sum(top_price/{c}) FILTER (top_price>0 AND {c}>0),0)"
_F = lambda c: f"sum(top_price) FILTER (top_price>0)/nullif(sum(top_price/nullif({c},0)),0)"
_D = "sum(top_price*gross_profit_margin)/sum(top_price)"


@query("a06_industry_valuation", sql("fund", f"SELECT l1, {R(_H('pe_ttm'))} AS pe_ttm, {R(_H('pb'))} AS pb, {R(_D)} AS gross_profit_margin FROM fund GROUP BY 1"))
def _(v):
    return rounded(M.weighted_valuation(v.fund, "l1", ["pe_ttm", "pb"], "top_price", "gross_profit_margin"), "pe_ttm", "pb", "gross_profit_margin")


@query("a06_industry_valuation_full", sql("fund", f"SELECT l1, {R(_F('pe_ttm'), 4)} AS pe_ttm, {R(_F('pb'), 4)} AS pb, {R(_D)} AS gross_profit_margin FROM fund GROUP BY 1"))
def _(v):
    df = M.weighted_valuation(v.fund, "l1", ["pe_ttm", "pb"], "top_price", "gross_profit_margin", full=True)
    return rounded(rounded(df, "pe_ttm", "pb", d=4), "gross_profit_margin")


cte("hp", "SELECT symbol, close, w, n, (close-w)/nullif(w,0)*100 AS pct, 100e0*n AS p FROM (SELECT symbol, arg_max(close,trade_date) AS close, avg(close) AS w, count(*) FILTER (volume>30)/count(*) AS n FROM raw GROUP BY 1)", "raw")
cte(
    "hp2",
    """SELECT symbol, close-w AS d, pct, CASE WHEN close>w THEN CASE WHEN pct>10 THEN 'far_above' ELSE 'above' END WHEN close<w THEN CASE WHEN pct<-10 THEN 'far_below' ELSE 'below' END ELSE 'at_cost' END AS cost_class,
    CASE WHEN p<=20 THEN 'low' WHEN p<=50 THEN 'mid_low' WHEN p<=80 THEN 'mid_high' ELSE 'high' END AS participation_class,
    CASE WHEN p>=80 AND abs(pct)<=10 THEN 'high' WHEN p>=50 AND abs(pct)<=15 THEN 'medium' WHEN p>=20 THEN 'light' ELSE 'low' END AS control_strength FROM hp""",
    "hp",
)


def holders(v):
    g = v.raw.groupBy("symbol").agg(F.max_by("close", "trade_date").alias("close"), F.avg("close").alias("w"), (100.0 * F.count(F.when(F.col("volume") > 30, 1)) / F.count(F.lit(1))).alias("p"))
    return g.withColumns(M.holder_position(F.col("w"), F.col("close"), F.col("p")))


@query("c28_holder_position", sql("hp2", f"SELECT symbol, {R('d', 4)} AS cost_diff, {R('pct', 4)} AS cost_pct, cost_class, participation_class, control_strength FROM hp2"))
def _(v):
    return rounded(holders(v).select("symbol", "cost_diff", "cost_pct", "cost_class", "participation_class", "control_strength"), "cost_diff", "cost_pct", d=4)


@query("a35_holder_summary", sql("hp2", "SELECT cost_class, control_strength, count(*) AS n FROM hp2 GROUP BY 1,2"))
def _(v):
    return holders(v).groupBy("cost_class", "control_strength").agg(F.count(F.lit(1)).alias("n"))
