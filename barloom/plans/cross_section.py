"""Cross-sectional factor queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import cross_section as X, market as M, portfolio as P, signals as S
from barloom.operators.scaling import reuse
from barloom.plans import signals as _signals  # noqa: F401  its views come first
from barloom.plans.aggregates import event_sources
from barloom.plans.registry import R, Rs, avgrank, cte, full, over, pctrank, query, r, rounded, sql, zsql

# Latest 21 rows per symbol and the raw price factors.
cte("tail21", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS rn, close/lag(close) OVER (PARTITION BY symbol ORDER BY trade_date)-1 AS ret FROM adj", "adj")
cte(
    "price_factors",
    """SELECT t.symbol, l1, l2, arg_max(close,trade_date)/arg_min(close,trade_date)-1 AS momentum_raw,
    CASE WHEN count(*) FILTER (rn<=20)<5 THEN 0e0 ELSE arg_max(volume,trade_date)/greatest(avg(volume) FILTER (rn<=20),1e0) END AS liquidity_raw,
    CASE WHEN count(*) FILTER (rn<=20)<5 THEN 0e0 ELSE -stddev_samp(ret) FILTER (rn<=19) END AS volatility_raw
    FROM tail21 t JOIN industry USING (symbol) WHERE rn<=21 GROUP BY ALL""",
    "tail21",
    "industry",
)
cte(
    "qv",
    f"""SELECT *, roe*0.30e0+gross_profit_margin*0.20e0+net_profit_margin*0.20e0+revenue_growth*0.15e0+net_profit_growth*0.15e0 AS quality_raw,
    CASE WHEN pe_ttm>0 AND pe_ttm<=200 THEN pe_ttm END AS pec, CASE WHEN pb>0 AND pb<=100 THEN pb END AS pbc FROM fund""",
    "fund",
)
cte(
    "flow4",
    f"""SELECT symbol, {', '.join(f'arg_max(f{n}, trade_date) AS flow_{n}' for n in (3, 5, 10, 20))} FROM (
    SELECT symbol, trade_date, {', '.join(f'{over("sum(net)", n)} AS f{n}' for n in (3, 5, 10, 20))} FROM daily_flow) GROUP BY symbol""",
    "daily_flow",
)


def price_factors(v):
    f = X.momentum(v.adj).join(X.liquidity(v.adj), "symbol").join(X.volatility(v.adj), "symbol")
    return f.join(v.industry.select("symbol", "l1", "l2"), "symbol")


@query("x01_industry_zscore", sql("fund", f"SELECT symbol, l1, {R(zsql('roe', 'l1'))} AS z FROM fund"))
def _(v):
    return rounded(X.zscore(v.fund, ["l1"], {"z": "roe"}).select("symbol", "l1", "z"), "z")


@query("x01_daily_industry_zscore", sql("adj industry", f"SELECT symbol, trade_date, {R(zsql('close', 'trade_date, l1'))} AS z FROM adj JOIN industry USING (symbol)"))
def _(v):
    df = v.adj.join(v.industry.select("symbol", "l1"), "symbol")
    return rounded(X.zscore(df, ["trade_date", "l1"], {"z": "close"}).select("symbol", "trade_date", "z"), "z")


@query("x02_percent_rank", sql("adj", f"SELECT symbol, trade_date, {R(pctrank('volume', 'trade_date'))} AS pct FROM adj"))
def _(v):
    return rounded(X.percent_rank(v.adj, ["trade_date"], {"pct": "volume"}).select("symbol", "trade_date", "pct"), "pct")


@query("x03_rank_score", sql("fund", f"SELECT symbol, {R(pctrank('net_profit_margin') + '*99+1')} AS score FROM fund"))
def _(v):
    df = X.percent_rank(v.fund, [], {"p": "net_profit_margin"})
    return df.select("symbol", r(F.col("p") * 99 + 1).alias("score"))


@query("x04_quality", sql("qv", f"SELECT symbol, {R(zsql('quality_raw', 'l1'))} AS quality FROM qv"))
def _(v):
    return rounded(X.zscore(X.quality(v.fund), ["l1"], {"quality": "quality_raw"}).select("symbol", "quality"), "quality")


@query("x05_valuation", sql("qv", f"SELECT symbol, {R('-(' + zsql('pec', 'l1') + '+' + zsql('pbc', 'l1') + ')/2')} AS valuation FROM qv"))
def _(v):
    return rounded(X.valuation(v.fund, ["l1"]).select("symbol", "valuation"), "valuation")


for _name, _op in (("x06_momentum", "momentum"), ("x07_liquidity", "liquidity"), ("x08_volatility", "volatility")):

    def _build(v, op=_op):
        raw = getattr(X, op)(v.adj).join(v.industry.select("symbol", "l1"), "symbol")
        return rounded(X.zscore(raw, ["l1"], {op: f"{op}_raw"}).select("symbol", f"{op}_raw", op), f"{op}_raw", op)

    query(_name, sql("price_factors", f"SELECT symbol, {Rs(_op + '_raw')}, {R(zsql(_op + '_raw', 'l1'))} AS {_op} FROM price_factors"))(_build)

CLASS = {"AFRICA": "cyclical", "AMERICA": "technology", "ASIA": "consumer", "EUROPE": "finance", "MIDDLE EAST": "defensive"}
_CLS = "CASE l1 " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in CLASS.items()) + " END"
cte(
    "macro",
    f"""SELECT month, CASE WHEN p>0.5 THEN 'boom' WHEN p<-0.5 THEN 'recession' ELSE 'normal' END AS regime FROM (SELECT *,
    CASE WHEN pmi>50.5 THEN 1e0 WHEN pmi<49.5 THEN -1e0 ELSE 0e0 END + CASE WHEN m2>10 THEN 0.5e0 WHEN m2<8 THEN -0.5e0 ELSE 0e0 END
    + CASE WHEN cpi>3 THEN -0.5e0 WHEN cpi<0.5 THEN -0.5e0 WHEN cpi IS NOT NULL THEN 0.3e0 ELSE 0e0 END AS p FROM (
    SELECT date_trunc('month', o_orderdate)::DATE AS month, 100e0*count(*) FILTER (o_orderpriority<'3')/count(*) + 10 AS pmi,
    30e0*count(*) FILTER (o_orderstatus='F')/count(*) AS m2, 9e0*count(*) FILTER (o_orderstatus='P')/count(*) AS cpi FROM orders GROUP BY 1))""",
)
_TILT = "CASE " + " ".join(f"WHEN regime='{g}' AND cls='{c}' THEN {t}e0" for g, ts in X.REGIME_TILT.items() for c, t in ts.items() if t) + " ELSE 0e0 END"


def regimes(v):
    """Macro regime of each month."""
    n = F.count(F.lit(1))
    m = v.table("orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(
        (100.0 * F.count(F.when(F.col("o_orderpriority") < "3", 1)) / n + 10).alias("pmi"),
        (30.0 * F.count(F.when(F.col("o_orderstatus") == "F", 1)) / n).alias("m2"),
        (9.0 * F.count(F.when(F.col("o_orderstatus") == "P", 1)) / n).alias("cpi"),
    )
    return m.select("month", X.macro_regime(F.col("pmi"), F.col("m2"), F.col("cpi")).alias("regime"))


@query("x09_macro_tilt", sql("macro industry", f"SELECT month, regime, l1, {_TILT} AS tilt FROM macro CROSS JOIN (SELECT DISTINCT l1, {_CLS} AS cls FROM industry)"))
def _(v):
    m = regimes(v)
    cls = F.create_map(*[F.lit(x) for kv in CLASS.items() for x in kv])
    m = m.withColumn("l1", F.explode(F.array(*[F.lit(k) for k in CLASS])))  # five fixed classes
    return m.withColumn("tilt", X.macro_tilt(F.col("regime"), F.element_at(cls, F.col("l1"))))


cte(
    "forward_in",
    """SELECT *, CASE WHEN pct>40 THEN 1e0 WHEN pct>35 THEN 0.5e0 WHEN pct>30 THEN -0.5e0 ELSE -1e0 END AS surprise,
    revenue_growth*1e0+net_profit_growth*0.5e0-roe*0.5e0 AS analyst FROM (SELECT *, revenue_growth AS pct FROM fund)""",
    "fund",
)
cte("forward_raw", f"SELECT *, surprise*0.6e0+({pctrank('analyst')}*2-1)*0.4e0 AS forward_raw FROM forward_in", "forward_in")


@query("x10_forward", sql("forward_raw", f"SELECT symbol, {R(zsql('forward_raw', 'l1'))} AS financial_forward FROM forward_raw"))
def _(v):
    g = F.col("revenue_growth")
    kind = F.when(g > 40, "预增").when(g > 35, "略增").when(g > 30, "略减").otherwise("首亏")
    df = v.fund.withColumn("surprise", X.surprise_score(kind)).withColumn("analyst", X.consensus(g, F.col("net_profit_growth"), F.col("roe")))
    return rounded(X.zscore(X.forward_factor(df), ["l1"], {"financial_forward": "forward_raw"}).select("symbol", "financial_forward"), "financial_forward")


@query("x12_sentiment", sql("fund", f"SELECT symbol, {R(zsql('s', 'l1'))} AS news_sentiment FROM (SELECT *, (roe-5)*0.7e0+ln(1+n_trades)*0.3e0 AS s FROM fund)"))
def _(v):
    df = v.fund.withColumn("s", X.sentiment_raw(F.col("roe") - 5, F.col("n_trades")))
    return rounded(X.zscore(df, ["l1"], {"news_sentiment": "s"}).select("symbol", "news_sentiment"), "news_sentiment")


cte("tt", "SELECT f.symbol, f.l1, flow_20/1e4+n_trades*10 AS t FROM fund f JOIN flow4 USING (symbol)", "fund", "flow4")


@query("x13_ranking_list", sql("tt", f"SELECT symbol, {R(zsql('t', 'l1'))} AS top_trader FROM tt"))
def _(v):
    df = v.fund.join(X.flow_sums(v.daily_flow), "symbol").withColumn("t", X.top_trader_raw(F.col("flow_20") / 1e4, F.col("n_trades")))
    return rounded(X.zscore(df, ["l1"], {"top_trader": "t"}).select("symbol", "top_trader"), "top_trader")


_MF = "(flow_3*0.3e0+flow_5*0.4e0+flow_10*0.2e0+flow_20*0.1e0)/(0.3e0+0.4e0+0.2e0+0.1e0)"
cte("mf", f"SELECT symbol, l1, {_MF} AS m FROM flow4 JOIN industry USING (symbol)", "flow4", "industry")


@query("x14_money_flow", sql("mf", f"SELECT symbol, {R(zsql('m', 'l1'))} AS moneyflow FROM mf"))
def _(v):
    df = X.flow_sums(v.daily_flow).join(v.industry.select("symbol", "l1"), "symbol").withColumn("m", X.moneyflow_raw())
    return rounded(X.zscore(df, ["l1"], {"moneyflow": "m"}).select("symbol", "moneyflow"), "moneyflow")


# --- fusion ---------------------------------------------------------------------------------

FACTORS = tuple(X.PRIOR_WEIGHTS)
cte("macd_last", "SELECT symbol, arg_max(score, trade_date) AS macd_raw FROM sigf GROUP BY symbol", "sigf")
cte("regime_last", "SELECT arg_max(regime, month) AS regime FROM macro", "macro")
_Z = {"macd": "macd_raw", "momentum": "momentum_raw", "quality": "quality_raw", "liquidity": "liquidity_raw", "volatility": "volatility_raw", "moneyflow": "m", "top_trader": "t", "financial_forward": "forward_raw", "event_driven": "event_score", "news_sentiment": "sent"}
cte(
    "zf",
    f"""SELECT symbol, l1, {', '.join(f'{zsql(c, "l1")} AS {f}' for f, c in _Z.items())}, -({zsql('pec', 'l1')}+{zsql('pbc', 'l1')})/2 AS valuation,
    {_TILT.replace('cls', _CLS)} AS macro FROM (SELECT p.*, quality_raw, pec, pbc, m, t, forward_raw, event_score, macd_raw, regime, (f.roe-5)*0.7e0+ln(1+f.n_trades)*0.3e0 AS sent
    FROM price_factors p JOIN qv ON p.symbol=qv.symbol JOIN mf ON p.symbol=mf.symbol JOIN tt ON p.symbol=tt.symbol JOIN forward_raw f ON p.symbol=f.symbol
    LEFT JOIN evs ON p.symbol=evs.symbol LEFT JOIN macd_last ON p.symbol=macd_last.symbol CROSS JOIN regime_last)""",
    "price_factors",
    "qv",
    "mf",
    "tt",
    "forward_raw",
    "evs",
    "macd_last",
    "regime_last",
)
_SUM = "+".join(FACTORS)
_PRIOR = " ".join(f"WHEN '{k}' THEN {w}e0" for k, w in X.PRIOR_WEIGHTS.items())
_REST = sum(w for k, w in X.PRIOR_WEIGHTS.items() if k not in FACTORS)
cte(
    "icw",
    f"""SELECT factor, greatest(0e0, CASE WHEN stddev_pop(ra)>0 AND stddev_pop(rb)>0 THEN corr(ra, rb) ELSE 0 END) AS ic FROM (SELECT factor, {avgrank('v', 'factor')} AS ra, {avgrank('c', 'factor')} AS rb FROM ("""
    + " UNION ALL ".join(f"SELECT '{f}' AS factor, {f} AS v, ({_SUM}-{f})/{len(FACTORS) - 1} AS c FROM zf" for f in FACTORS)
    + ")) GROUP BY factor",
    "zf",
)
cte(
    "wts",
    f"""SELECT factor, ic, b/(sum(b) OVER () + 0.7e0*{_REST}e0) AS weight FROM (
    SELECT *, 0.7e0*CASE factor {_PRIOR} END + 0.3e0*ic/sum(ic) OVER () AS b FROM icw)""",
    "icw",
)


def z_factors(v):
    """All weighted factors of each symbol, as z-scores within the industry; the macro tilt is its own scale."""
    growth, cls = F.col("revenue_growth"), F.create_map(*[F.lit(x) for kv in CLASS.items() for x in kv])
    kind = F.when(growth > 40, "预增").when(growth > 35, "略增").when(growth > 30, "略减").otherwise("首亏")
    f = v.fund.withColumn("surprise", X.surprise_score(kind)).withColumn("analyst", X.consensus(growth, F.col("net_profit_growth"), F.col("roe")))
    f = X.forward_factor(f).withColumn("news_sentiment_raw", X.sentiment_raw(F.col("roe") - 5, F.col("n_trades"))).select("symbol", F.col("forward_raw").alias("financial_forward_raw"), "news_sentiment_raw", F.col("n_trades").alias("_n"))
    macd = S.signals(v.histories).groupBy("symbol").agg(F.max_by("score", "trade_date").alias("macd_raw"))
    df = price_factors(v).join(X.quality(v.fund).drop("l1", "l2", "name"), "symbol").join(f, "symbol")
    df = df.join(X.flow_sums(v.daily_flow), "symbol").withColumn("moneyflow_raw", X.moneyflow_raw()).withColumn("top_trader_raw", X.top_trader_raw(F.col("flow_20") / 1e4, F.col("_n")))
    df = df.join(M.event_score(event_sources(v)).select("symbol", F.col("event_score").alias("event_driven_raw")), "symbol", "left").join(macd, "symbol", "left")
    df = X.zscore(df, ["l1"], {f: f"{f}_raw" for f in FACTORS if f not in ("valuation", "macro")})
    now = F.lit(regimes(v).agg(F.max_by("regime", "month")).scalar())
    df = df.withColumn("macro", X.macro_tilt(now, F.element_at(cls, F.col("l1"))))
    return reuse(X.valuation(df, ["l1"]).select("symbol", "l1", *FACTORS))


@query("x15_consensus_ic_weights", sql("wts", f"SELECT factor, {Rs('ic weight')} FROM wts"))
def _(v):
    return rounded(X.consensus_weights(z_factors(v), FACTORS), "ic", "weight")


cte(
    "fused",
    "SELECT symbol, l1, " + ", ".join(FACTORS) + ", " + "+".join(f"{f}*(SELECT weight FROM wts WHERE factor='{f}')" for f in FACTORS) + " AS fused FROM zf",
    "zf",
    "wts",
)
cte("scored", f"SELECT *, {pctrank('fused')}*99+1 AS score FROM fused", "fused")


def scored(v):
    z = z_factors(v)
    return X.fuse(z, FACTORS, X.consensus_weights(z, FACTORS))


@query(
    "x16_factor_fusion",
    sql(
        "scored",
        f"SELECT symbol, {R('score')} AS score, {R(pctrank('score', 'l1') + '*100')} AS score_pct, {R(pctrank('momentum', 'l1') + '*100')} AS momentum_pct, {R(pctrank('quality', 'l1') + '*100')} AS quality_pct FROM scored",
    ),
)
def _(v):
    df = X.percent_rank(scored(v), ["l1"], {"score_pct": "score", "momentum_pct": "momentum", "quality_pct": "quality"})
    return df.select("symbol", r("score").alias("score"), *[r(F.col(c) * 100).alias(c) for c in ("score_pct", "momentum_pct", "quality_pct")])


cte("isig", "SELECT symbol, l1, score, CASE l1 WHEN 'AFRICA' THEN 'core' WHEN 'AMERICA' THEN 'momentum' WHEN 'ASIA' THEN 'overheated' WHEN 'EUROPE' THEN 'neutral' ELSE '' END AS s FROM scored", "scored")
cte(
    "neut",
    f"""SELECT *, CASE WHEN p<=25 AND g>=70 THEN -10 WHEN p>=75 AND g<=40 THEN -5 ELSE 0 END AS dev FROM (SELECT *, {pctrank('score', 'l1')}*100 AS p,
    CASE s WHEN 'core' THEN 80 WHEN 'momentum' THEN 70 WHEN 'contrarian' THEN 50 WHEN 'neutral' THEN 40 WHEN 'overheated' THEN 30 ELSE 50 END AS g FROM isig)""",
    "isig",
)


@query("x17_industry_neutralisation", sql("neut", f"SELECT symbol, {R('p')} AS industry_pct, g AS industry_signal_score, dev AS industry_deviation, {R('greatest(score+dev,0e0)')} AS score FROM neut"))
def _(v):
    sig = F.create_map(*[F.lit(x) for kv in {"AFRICA": "core", "AMERICA": "momentum", "ASIA": "overheated", "EUROPE": "neutral"}.items() for x in kv])
    df = scored(v).withColumn("industry_signal", F.coalesce(F.try_element_at(sig, F.col("l1")), F.lit("")))
    return rounded(X.neutralise(df, "score", "l1").select("symbol", "industry_pct", "industry_signal_score", "industry_deviation", "score"), "industry_pct", "score")


# --- industry and fund scores ---------------------------------------------------------------

cte(
    "ibars",
    "SELECT l2 AS symbol, trade_date, avg(close) AS close, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM adj JOIN industry USING (symbol) GROUP BY 1,2",
    "adj",
    "industry",
)
cte("ival", "SELECT l2 AS symbol, avg(pe_ttm) AS pe_ttm, avg(pb) AS pb, avg(gross_profit_margin) AS div_yield FROM fund GROUP BY 1", "fund")
cte("ima", "SELECT *, " + ", ".join(f"{full('avg(close)', p)} AS m{p}" for p in (10, 20, 30, 60, 90)) + f", {full('avg(volume)', 20, 'volume')} AS v20, {full('avg(amount)', 60, 'amount')} AS a60 FROM ibars", "ibars")
cte(
    "itr",
    f"""SELECT symbol, b, pe, pb, dy, {pctrank('pe')} AS rpe, {pctrank('pb')} AS rpb, {pctrank('dy')} AS rdy, {pctrank('dev')} AS rm, {pctrank('vr')} AS rv, {pctrank('ar')} AS ra FROM (
    SELECT x.symbol, coalesce((m10>m20)::INT,0)+coalesce((m20>m30)::INT,0)+coalesce((m30>m60)::INT,0)+coalesce((m60>m90)::INT,0) AS b,
    (close-m60)/nullif(m60,0)*100 AS dev, volume/nullif(v20,0) AS vr, amount/nullif(a60,0) AS ar, CASE WHEN pe_ttm>0 THEN pe_ttm END AS pe,
    CASE WHEN i.pb>0 THEN i.pb END AS pb, coalesce(div_yield,0) AS dy
    FROM (SELECT * FROM ima QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC)=1) x LEFT JOIN ival i ON x.symbol=i.symbol)""",
    "ima",
    "ival",
)
cte(
    "itf",
    """SELECT *, coalesce(fv,50)*0.35e0+ft*0.40e0+fq*0.25e0 AS ts FROM (SELECT symbol, b, (100-rpe*100)*0.4e0+(100-rpb*100)*0.3e0+rdy*100*0.3e0 AS fv,
    b/4e0*100*0.5e0+rm*100*0.5e0 AS ft, rv*100*0.5e0+ra*100*0.5e0 AS fq FROM itr)""",
    "itr",
)


@query(
    "x30_industry_scoring",
    sql(
        "itf",
        f"""SELECT symbol, CAST(b AS INT) AS bull_align, {R('fv', 4)} AS factor_value, {R('ft', 4)} AS factor_trend, {R('fq', 4)} AS factor_volume, {R('ts', 4)} AS total_score,
        CASE WHEN ts>75 AND fv>70 THEN 'core' WHEN ts>70 AND ft>80 THEN 'momentum' WHEN fv>85 AND ft<40 THEN 'contrarian' WHEN ft>80 AND fv<30 THEN 'overheated' ELSE 'neutral' END AS industry_signal FROM itf""",
    ),
)
def _(v):
    bars = v.adj.join(v.industry.select("symbol", "l2"), "symbol").groupBy(F.col("l2").alias("symbol"), "trade_date").agg(
        F.avg("close").alias("close"), F.sum("volume").alias("volume"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount")
    )
    val = v.fund.groupBy(F.col("l2").alias("symbol")).agg(F.avg("pe_ttm").alias("pe_ttm"), F.avg("pb").alias("pb"), F.avg("gross_profit_margin").alias("div_yield"))
    return rounded(X.industry_trend(bars, val), "factor_value", "factor_trend", "factor_volume", "total_score", d=4)


cte(
    "fmom",
    """SELECT *, greatest(least(g10/0.5e0,1e0),0e0)*0.4e0+greatest(least(g20/0.5e0,1e0),0e0)*0.6e0 AS sp FROM (SELECT *,
    greatest(least(CASE WHEN t10>0 THEN t5/t10 ELSE 0 END*0.5e0+CASE WHEN t20>0 THEN t5/t20 ELSE 0 END*0.25e0,1e0),0e0) AS tr,
    (t5/5-t10/10)/nullif(t10/10+1e-5,0) AS g10, (t5/5-t20/20)/nullif(t20/20+1e-5,0) AS g20 FROM (
    SELECT symbol, flow_5/1e4 AS t5, flow_10/1e4 AS t10, flow_20/1e4 AS t20 FROM flow4))""",
    "flow4",
)


@query(
    "x31_fund_momentum",
    sql(
        "fmom",
        f"""SELECT symbol, {R('tr')} AS flow_trend, {R('sp')} AS flow_speed, {R('tr*0.4e0+sp*0.6e0')} AS flow_momentum,
        CASE WHEN t5<=0 THEN 'outflow' WHEN tr>=0.6 AND sp>=0.6 THEN 'strong_advance' WHEN tr<0.3 AND sp>=0.6 THEN 'returning'
        WHEN tr>=0.6 AND sp<0.3 THEN 'fading' WHEN sp>=0.3 AND sp<0.6 THEN 'mild_inflow' ELSE 'watch' END AS flow_signal FROM fmom""",
    ),
)
def _(v):
    f = X.flow_sums(v.daily_flow)
    cols = X.fund_momentum(F.col("flow_5") / 1e4, F.col("flow_10") / 1e4, F.col("flow_20") / 1e4)
    return rounded(f.withColumns(cols).select("symbol", *cols), "flow_trend", "flow_speed", "flow_momentum")


_W33 = {"momentum": 0.5, "quality": 0.3, "valuation": 0.2}
cte("rs", "SELECT symbol, momentum*0.5e0+quality*0.3e0+valuation*0.2e0 AS w FROM zf", "zf")


@query("x33_strategy_rescore", sql("rs", f"SELECT symbol, {R('(w-min(w) OVER ())/nullif(max(w) OVER ()-min(w) OVER (),0)*100')} AS score FROM rs"))
def _(v):
    return rounded(X.rescore(z_factors(v), _W33).select("symbol", "score"), "score")


# --- flagship -------------------------------------------------------------------------------

_FW = {"momentum": 0.4, "valuation": 0.3, "volatility": 0.3}
cte("fl", f"SELECT symbol, l1, {pctrank('momentum*0.4e0+valuation*0.3e0+volatility*0.3e0')}*99+1 AS score FROM zf", "zf")
cte("fl2", "SELECT *, sum(score) OVER () AS t FROM fl QUALIFY row_number() OVER (ORDER BY score DESC, symbol)<=20", "fl")
cte("fl3", "SELECT *, sum(score/t) OVER (PARTITION BY l1) AS it, row_number() OVER (PARTITION BY l1 ORDER BY score DESC, symbol) AS rk FROM (SELECT symbol, l1, score, sum(score) OVER () AS t FROM (SELECT symbol, l1, score FROM fl ORDER BY score DESC, symbol LIMIT 20))", "fl")


@query(
    "flagship_top20",
    sql("fl3", f"SELECT symbol, l1 AS industry, {R('score')} AS score, {R('CASE WHEN it<=0.3 THEN score/t WHEN rk=1 THEN least(score/t,0.3e0) ELSE 0e0 END')} AS position FROM fl3"),
)
def _(v):
    raw = X.momentum(v.adj).join(X.volatility(v.adj), "symbol").join(v.industry.withColumn("pe_ttm", F.col("acctbal") / 50).withColumn("pb", F.col("acctbal") / 100), "symbol")
    z = X.valuation(X.zscore(raw, ["l1"], {"momentum": "momentum_raw", "volatility": "volatility_raw"}), ["l1"])
    z = z.withColumn("fused", F.col("momentum") * 0.4 + F.col("valuation") * 0.3 + F.col("volatility") * 0.3)
    s = X.percent_rank(z, [], {"p": "fused"}).select("symbol", F.col("l1").alias("industry"), (F.col("p") * 99 + 1).alias("score"))
    top = s.orderBy(F.desc("score"), "symbol").limit(20)  # a top-k report
    t = top.agg(F.sum("score")).scalar()
    return rounded(P.industry_cap(top.withColumn("position", F.col("score") / t)), "score", "position")
