"""Price-limit, market-state and cost queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import costs as C
from barloom.operators import limits as L, risk, trend
from barloom.operators.panel import by_symbol, full as pfull
from barloom.plans.registry import R, Rs, cte, full, lag, query, r, rounded, sql

HU = lambda x: f"CAST(round(CAST(round({x},8) AS DECIMAL(30,8)),2) AS DOUBLE)"
cte("lm0", f"SELECT *, {lag('close')} AS pc FROM raw", "raw")
cte("lm1", f"SELECT *, {HU('pc*(1+0.10e0)')} AS limit_up, {HU('pc*(1-0.10e0)')} AS limit_down FROM lm0", "lm0")
cte("lm2", "SELECT *, coalesce(open>=limit_up-1e-9,false) AS ou, coalesce(open<=limit_down+1e-9,false) AS od, coalesce(close>=limit_up-1e-9,false) AS cu, coalesce(close<=limit_down+1e-9,false) AS cd, coalesce(high>=limit_up-1e-9,false) AS hu, coalesce(low<=limit_down+1e-9,false) AS ld FROM lm1", "lm1")
cte(
    "lm3",
    f"""SELECT *, CASE WHEN cd AND od THEN 'seal_down' WHEN cu AND ou THEN 'seal_up' WHEN ou AND NOT cu THEN 'open_up' WHEN od AND NOT cd THEN 'open_down'
    WHEN (cu OR hu) AND NOT ou THEN 'intraday_up' WHEN (cd OR ld) AND NOT od THEN 'intraday_down' ELSE '' END AS day_type,
    CASE WHEN od THEN 'auction_down' WHEN ou THEN 'auction_up' ELSE '' END AS auction_type, cu::INT-cd::INT AS k FROM lm2""",
    "lm2",
)
cte("lm4", f"SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY trade_date) AS run FROM (SELECT *, CASE WHEN {lag('k')}=k THEN 0 ELSE 1 END AS nw FROM lm3)", "lm3")
cte("lim", f"SELECT *, CAST(CASE WHEN k=0 THEN 0 ELSE k*row_number() OVER (PARTITION BY symbol, run ORDER BY trade_date) END AS INT) AS streak, volume/nullif({lag('volume')},0) AS vr FROM lm4", "lm4")
cte("limb", "SELECT *, least(3,greatest(1,abs(streak))) AS bucket FROM lim", "lim")


@query("w45_limit_classification", sql("lim", "SELECT symbol, trade_date, limit_up, limit_down, day_type, auction_type, streak FROM lim"))
def _(v):
    return L.classify(v.raw).select("symbol", "trade_date", "limit_up", "limit_down", "day_type", "auction_type", "streak")


_Q = ", ".join(f"{R(f'quantile_cont(vr,{q})')} AS {n}" for n, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9)))


@query("a09_fill_calibration", sql("limb", f"SELECT day_type AS kind, bucket, count(*) AS n, {_Q} FROM limb WHERE day_type<>'' AND vr>0 AND vr<=10 GROUP BY 1,2"))
def _(v):
    return rounded(L.calibrate(L.classify(v.raw)), "p10", "p50", "p90")


@query("a10_daily_touch_counts", sql("lim", "SELECT trade_date, " + ", ".join(f"count(*) FILTER (day_type='{k}') AS {k}" for k in ("seal_up", "seal_down", "open_up")) + ", count(*) FILTER (auction_type<>'') AS auction_touch FROM lim GROUP BY 1"))
def _(v):
    return L.daily_counts(L.classify(v.raw))


cte("sw", "SELECT row_number() OVER w AS i, sum(auction_touch) OVER s AS n, min(trade_date) OVER s AS b, trade_date AS e FROM (SELECT trade_date, count(*) FILTER (auction_type<>'') AS auction_touch FROM lim GROUP BY 1) WINDOW w AS (ORDER BY trade_date), s AS (ORDER BY trade_date ROWS 4 PRECEDING)", "lim")
cte("sw1", "SELECT * FROM sw WHERE i>=5 AND n>0 ORDER BY n DESC, i LIMIT 1", "sw")
cte("sw2", "SELECT sw.* FROM sw, sw1 p WHERE sw.i>=5 AND sw.n>0 AND abs(sw.i-p.i)>=5 ORDER BY sw.n DESC, sw.i LIMIT 1", "sw1")
cte("sw3", "SELECT sw.* FROM sw, sw1 p, sw2 q WHERE sw.i>=5 AND sw.n>0 AND abs(sw.i-p.i)>=5 AND abs(sw.i-q.i)>=5 ORDER BY sw.n DESC, sw.i LIMIT 1", "sw2")


@query("w47_stress_windows", sql("sw3", """SELECT b AS start, e AS "end", CAST(n AS BIGINT) AS count, n/5e0 AS mean_per_day FROM (SELECT * FROM sw1 UNION ALL SELECT * FROM sw2 UNION ALL SELECT * FROM sw3)"""))
def _(v):
    return L.stress_windows(L.daily_counts(L.classify(v.raw)), "auction_touch")


@query("c10_half_up_rounding", f"SELECT l_orderkey, l_linenumber, {HU('l_extendedprice*0.105e0')} AS rounded, floor(l_extendedprice*0.105e0*100+0.5e0)/100 AS tick FROM lineitem")
def _(v):
    from barloom.operators.panel import tick

    x = F.col("l_extendedprice") * 0.105
    return v.table("lineitem").select("l_orderkey", "l_linenumber", L.half_up(x).alias("rounded"), tick(x).alias("tick"))


cte("c11", f"SELECT symbol, trade_date, pc, i+1 AS days, volume>45 AS st, trade_date>=DATE '1998-06-01' AS nw FROM lm0", "lm0")


@query(
    "c11_limit_prices",
    sql("c11", f"""SELECT symbol, trade_date, {HU('pc*(1+u)')} AS limit_up, {HU('pc*(1-d)')} AS limit_down FROM (SELECT *,
        CASE WHEN days=1 THEN 0.44e0 WHEN st THEN 0.05e0 ELSE 0.10e0 END AS u, CASE WHEN days=1 THEN 0.36e0 WHEN st THEN 0.05e0 ELSE 0.10e0 END AS d FROM c11)"""),
)
def _(v):
    df = trend.with_index(v.raw).withColumn("pc", F.lag("close").over(by_symbol()))
    u, d = L.limit_ratio(F.col("volume") > 45, F.col("i") + 1, F.col("trade_date"))
    return df.select("symbol", "trade_date", L.half_up(F.col("pc") * (1 + u)).alias("limit_up"), L.half_up(F.col("pc") * (1 - d)).alias("limit_down"))


_FILL = "CASE WHEN {k} LIKE 'seal%' THEN 0.05e0 WHEN {k} LIKE 'open%' OR {k} LIKE 'auction%' THEN 0.30e0 WHEN {k} LIKE 'intraday%' THEN 0.10e0 END"
_FR = lambda k: f"coalesce({_FILL.format(k=k)}*pow(0.5e0,greatest(abs(streak)-1,0)),1e0)"


@query("c12_fill_ratio", sql("lim", f"SELECT symbol, trade_date, {R(_FR('day_type'))} AS fill, {R(_FR('auction_type'))} AS auction_fill FROM lim"))
def _(v):
    df = L.classify(v.raw)
    return df.select("symbol", "trade_date", r(L.fill_ratio(F.col("day_type"), F.col("streak"))).alias("fill"), r(L.fill_ratio(F.col("auction_type"), F.col("streak"))).alias("auction_fill"))


cte("acal", "SELECT auction_type, bucket, count(*) AS n, quantile_cont(vr,0.5) AS p50 FROM limb WHERE auction_type<>'' AND vr>0 AND vr<=10 GROUP BY 1,2", "limb")


@query("c13_calibrated_fill", sql("limb acal", f"SELECT symbol, trade_date, {R('CASE WHEN n>=30 THEN least(1e0,p50) ELSE ' + _FR('l.auction_type') + ' END')} AS fill FROM limb l LEFT JOIN acal a ON l.auction_type=a.auction_type AND l.bucket=a.bucket"))
def _(v):
    c = L.classify(v.raw)
    return L.calibrated_fill(c, L.calibrate(c, "auction_type")).select("symbol", "trade_date", r("fill").alias("fill"))


@query("w46_exright_reference", sql("raw", f"SELECT symbol, trade_date, {R('CASE WHEN pf/adj_factor>0.1 AND pf/adj_factor<5 THEN pc*(pf/adj_factor) ELSE pc END')} AS reference FROM (SELECT *, {lag('close')} AS pc, {lag('adj_factor')} AS pf FROM raw)"))
def _(v):
    w = by_symbol()
    return v.raw.select("symbol", "trade_date", r(L.exright_reference(F.lag("close").over(w), F.col("adj_factor"), F.lag("adj_factor").over(w))).alias("reference"))


cte("ms0", f"SELECT trade_date, close/{lag('close')}-1 AS r1, close/{lag('close', 20)}-1 AS r20 FROM adj", "adj")
cte("ms1", "SELECT trade_date, quantile_cont(r20,0.5) AS ret20, stddev_samp(r1) AS vol FROM ms0 GROUP BY 1 HAVING stddev_samp(r1) IS NOT NULL", "ms0")
cte("ms2", "SELECT *, list(vol) OVER (ORDER BY trade_date ROWS 249 PRECEDING) AS h FROM ms1", "ms1")
cte("ms3", "SELECT *, CASE WHEN len(h)<60 THEN 0.5e0 ELSE len(list_filter(h, lambda x: x<=vol))/len(h) END AS vp FROM ms2", "ms2")


@query("w48_market_state", sql("ms3", f"SELECT trade_date, {R('ret20')} AS ret20, {R('vol')} AS vol, {R('vp')} AS vol_pct, CASE WHEN ret20>=0.02 THEN 1e0 WHEN ret20>=-0.02 AND vp<=0.8 THEN 0.5e0 ELSE 0.25e0 END AS multiplier FROM ms3"))
def _(v):
    return rounded(L.market_state(v.adj), "ret20", "vol", "vol_pct")


@query("w49_return_matrix", sql("adj", f"SELECT symbol, trade_date, {R('ret')} AS ret FROM (SELECT symbol, trade_date, close/{lag('close')}-1 AS ret FROM adj) WHERE ret IS NOT NULL AND trade_date<=DATE '1999-12-31'"))
def _(v):
    return risk.simple_returns(v.adj).where("ret is not null and trade_date <= '1999-12-31'").select("symbol", "trade_date", r("ret").alias("ret"))


cte("rt", f"SELECT trade_date, close/{lag('close')}-1 AS ret FROM adj", "adj")


@query("a07_market_breadth", sql("rt", f"SELECT trade_date, n, {R('u')} AS up_share, CASE WHEN n<=10 THEN 'UNKNOWN' WHEN u<0.25 THEN 'HIGH' WHEN u<0.35 OR u>0.70 THEN 'MEDIUM' ELSE 'LOW' END AS breadth_risk FROM (SELECT trade_date, count(*) AS n, avg(CASE WHEN ret>0 THEN 1e0 ELSE 0e0 END) AS u FROM rt WHERE ret IS NOT NULL GROUP BY 1)"))
def _(v):
    return rounded(L.breadth(risk.simple_returns(v.adj), 10), "up_share")


def _w(c, n):
    return f"CASE WHEN count(*) OVER (ORDER BY trade_date ROWS {n - 1} PRECEDING)>={n} THEN {c} OVER (ORDER BY trade_date ROWS {n - 1} PRECEDING) END"


cte("ix", f"SELECT *, {_w('avg(close)', 60)} AS m60, {_w('avg(close)', 120)} AS m120, {_w('min(low)', 60)} AS l60, close/lag(close) OVER (ORDER BY trade_date)*100-100 AS chg, {_w('avg(volume)', 5)}/nullif({_w('avg(volume)', 20)},0) AS ar FROM index_bars", "index_bars")
cte(
    "ixr",
    """SELECT trade_date, CASE WHEN m120 IS NULL THEN 'NORMAL' WHEN close<l60*1.02e0 THEN 'HIGH_RISK' WHEN close<m60 AND m60<m120 THEN 'HIGH_RISK' WHEN close<m60 AND m60>m120 THEN 'MEDIUM_RISK' ELSE 'NORMAL' END AS trend_risk,
    CASE WHEN chg<-1 AND ar<=0.8 THEN 'HIGH_RISK' WHEN chg<-2 AND ar>=1.5 THEN 'MEDIUM_RISK' WHEN chg>1 AND ar<=0.7 THEN 'HIGH_RISK' ELSE 'NORMAL' END AS volume_risk FROM ix""",
    "ix",
)


@query("w56_index_risk", sql("ixr", """SELECT *, CASE WHEN trend_risk='HIGH_RISK' OR volume_risk='HIGH_RISK' THEN 'SKIP_ALL' WHEN trend_risk='MEDIUM_RISK' OR volume_risk='MEDIUM_RISK' THEN 'CAUTION' ELSE 'NORMAL' END AS decision,
    CASE WHEN trend_risk='HIGH_RISK' OR volume_risk='HIGH_RISK' THEN 1e0 WHEN trend_risk='MEDIUM_RISK' OR volume_risk='MEDIUM_RISK' THEN 0.85e0 ELSE 1e0 END AS score_adjust FROM ixr"""))
def _(v):
    from barloom.operators.market import index_risk

    return index_risk(v.index_bars)


# --- costs ----------------------------------------------------------------------------------

cte("adv", f"SELECT symbol, trade_date, {full('avg(amount)', 20, 'amount', to=-1)} AS amount_ma20, {full('avg(volume)', 20, 'volume', to=-1)} AS adv, (high-low)/close AS amplitude FROM raw", "raw")


def _seg(segs, default):
    return "CASE " + " ".join(f"WHEN trade_date>=DATE '{d}' THEN CAST({x} AS DOUBLE)" for d, x in segs) + f" ELSE CAST({default} AS DOUBLE) END"


def _tier(vals, default):
    return "CASE tier " + " ".join(f"WHEN {i} THEN CAST({x} AS DOUBLE)" for i, x in enumerate(vals)) + f" ELSE CAST({default} AS DOUBLE) END"


def _cost_sql(rate="0.0003e0", slip="0.001e0"):
    return f"""SELECT *, greatest(value*{rate},5e0) AS commission, CASE WHEN action<>'buy' OR trade_date<DATE '2008-09-19' THEN value*{_seg(C.STAMP, 0.0005)} ELSE 0e0 END AS stamp,
    CASE WHEN trade_date>=DATE '2022-04-29' THEN value*{_seg(C.TRANSFER, 0.00001)} WHEN NOT main_market THEN 0e0 WHEN trade_date>=DATE '2012-09-01' THEN value*{_seg(C.TRANSFER, 0.00001)} ELSE qty*0.001e0 END AS transfer,
    0e0 AS handling, 0e0 AS regulator, value*greatest({slip},{_tier(C.TIER_SLIPPAGE_FLOOR, 0.0005)})*CASE WHEN amplitude>0.05 THEN 2 ELSE 1 END AS slippage,
    value*CASE WHEN part>{_tier(C.TIER_THRESHOLD, 0.01)} THEN least({_tier(C.TIER_IMPACT_BASE, 0.002)}*pow(part/({_tier(C.TIER_THRESHOLD, 0.01)}),1.5e0),{_tier(C.TIER_CAP, 0.05)}) ELSE 0e0 END AS impact
    FROM (SELECT t.*, amplitude, l1<>'ASIA' AS main_market, coalesce(least(greatest(qty/nullif(adv,0),0),1e0),0e0) AS part,
    CASE WHEN amount_ma20>0 THEN CASE WHEN amount_ma20<5e6 THEN 0 WHEN amount_ma20<2e7 THEN 1 WHEN amount_ma20<1e8 THEN 2 ELSE 3 END ELSE -1 END AS tier
    FROM trades t JOIN adv USING (symbol, trade_date) JOIN industry USING (symbol))"""


COMMISSION_TIERS = ((10_000, 0.00025), (30_000, 0.0002), (60_000, 0.00015))
_TIERED = "CASE " + " ".join(f"WHEN value>={s} THEN CAST({x} AS DOUBLE)" for s, x in reversed(COMMISSION_TIERS)) + " ELSE 0.0003e0 END"
cte("cst", _cost_sql(), "trades", "adv", "industry")
cte("cst_t", _cost_sql(_TIERED, "CASE WHEN discount>=0.05 THEN 0.0005e0 ELSE 0.001e0 END"), "trades", "adv", "industry")


def costed(v, order_type=None, **terms):
    b = v.raw.select(
        "symbol", "trade_date", pfull(F.avg("amount"), 20, src="amount", to=-1).alias("amount_ma20"), pfull(F.avg("volume"), 20, src="volume", to=-1).alias("adv"),
        ((F.col("high") - F.col("low")) / F.col("close")).alias("amplitude"),
    )
    t = v.trades.join(b, ["symbol", "trade_date"]).join(v.industry.select("symbol", (F.col("l1") != "ASIA").alias("main_market")), "symbol")
    return C.with_costs(t if order_type is None else t.withColumn("order_type", order_type), **terms)


_TOT = "+".join(C.COST_PARTS)


@query("c30_trade_costs", sql("cst", f"SELECT symbol, seq, tier, {Rs(' '.join(C.COST_PARTS), 4)}, {R(_TOT, 4)} AS total FROM cst"))
def _(v):
    return rounded(costed(v).select("symbol", "seq", "tier", *C.COST_PARTS, "total"), *C.COST_PARTS, "total", d=4)


@query("c30_tiered_limit_orders", sql("cst_t", f"SELECT symbol, seq, tier, {Rs(' '.join(C.COST_PARTS), 4)}, {R(_TOT, 4)} AS total FROM cst_t"))
def _(v):
    order_type = F.when(F.col("discount") >= 0.05, "limit").otherwise("market")
    df = costed(v, order_type, commission_tiers=COMMISSION_TIERS)
    return rounded(df.select("symbol", "seq", "tier", *C.COST_PARTS, "total"), *C.COST_PARTS, "total", d=4)


@query("a26_cost_breakdown", sql("cst", " UNION ALL ".join(f"SELECT '{c}' AS component, {R(f'sum({c})', 2)} AS amount, {R(f'sum({c})/sum({_TOT})')} AS share FROM cst" for c in C.COST_PARTS)))
def _(v):
    df = C.cost_summary(costed(v))
    return df.select("component", r("amount", 2).alias("amount"), r("share").alias("share"))



@query("c29_fee_rates", sql("trades", f"""SELECT DISTINCT trade_date, {_seg(C.STAMP, 0.0005)} AS stamp, {_seg(C.TRANSFER, 0.00001)} AS transfer, {_seg(C.HANDLING, 0.0000341)} AS handling, {_seg(C.REGULATOR, 0.00002)} AS regulator
    FROM (SELECT trade_date+9000 AS trade_date FROM trades UNION SELECT trade_date FROM trades)"""))
def _(v):
    d = v.trades.select("trade_date").distinct()
    d = d.unionByName(d.select(F.date_add("trade_date", 9000).alias("trade_date"))).distinct()
    c = F.col("trade_date")
    return d.select("trade_date", C.rate_on(c, C.STAMP, 0.0005).alias("stamp"), C.rate_on(c, C.TRANSFER, 0.00001).alias("transfer"), C.rate_on(c, C.HANDLING, 0.0000341).alias("handling"), C.rate_on(c, C.REGULATOR, 0.00002).alias("regulator"))
