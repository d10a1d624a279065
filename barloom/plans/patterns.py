"""Pattern and oscillator queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import patterns as P, trend
from barloom.plans.registry import R, cte, full, lag, over, query, rounded, sql

_B = lambda agg, n: f"{agg} OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
cte(
    "ks0",
    f"""SELECT *, coalesce(kdj_k>kdj_d AND {lag('kdj_k')}<={lag('kdj_d')},false) AS golden, coalesce(kdj_k<kdj_d AND {lag('kdj_k')}>={lag('kdj_d')},false) AS death, {lag('kdj_k')} AS p_k, {lag('kdj_j')} AS p_j,
    {lag('close')} AS p_close, {lag('kdj_j_slope')} AS p_j_slope, {lag('kdj_k_slope')} AS p_k_slope, {_B('min(kdj_k)', 9)} AS min_k9, {_B('min(low)', 9)} AS min_low9, {_B('min(kdj_k)', 4)} AS min_k4, {_B('min(kdj_d)', 4)} AS min_d4,
    {full('avg(close)', 5)} AS ma5, {over('max(kdj_k)', 20)} AS max_k20, {full('min(kdj_k)', 5, 'kdj_k')} AS k5, {over('count(*) FILTER (kdj_k<20)')} AS n_oversold FROM kdj""",
    "kdj",
)
cte("ks1", f"SELECT *, {lag('k5', 2)} AS support FROM ks0", "ks0")


@query("w31_kdj_signals", sql("ks1", "SELECT symbol, trade_date, concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in P.KDJ_SIGNALS.items()) + ") AS kdj_signals FROM ks1"))
def _(v):
    return P.kdj_signals(trend.kdj(v.histories)).select("symbol", "trade_date", "kdj_signals")


_C = lambda agg, n=5: f"{agg} OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {n} PRECEDING AND {n} FOLLOWING)"


def piv(c, k):
    return f"coalesce({_C(f'count({c})')}=11 AND {c}={_C(('max' if k == 'h' else 'min') + f'({c})')},false)"


cte("pvt", "SELECT *, " + ", ".join(f"{piv(c, k)} AS v{n}{k}" for n, c in (("p", "close"), ("q", "rsi"), ("s", "cci")) for k in "hl") + " FROM i_dx", "i_dx")


@query("w32_pivots", sql("pvt", "SELECT symbol, trade_date, vph AS pivot_high, vpl AS pivot_low FROM pvt"))
def _(v):
    hi, lo = P.pivots(v.histories, "close")
    return v.histories.select("symbol", "trade_date", hi.alias("pivot_high"), lo.alias("pivot_low"))


_L = lambda f, c: f"list({{'i': i, 'v': {c}}} ORDER BY i) FILTER ({f})"
cte("piv", "SELECT symbol, " + ", ".join(f"{_L('v' + n + k, c)} AS v{n}{k}" for n, c in (("p", "close"), ("q", "rsi"), ("s", "cci")) for k in "hl") + " FROM pvt GROUP BY 1", "pvt")


def _side(s, k):
    return f"""{s}l AS (SELECT symbol, vp{k}[-1] AS pl, vp{k}[-2] AS pp, list_filter(vq{k}, lambda x: x.i<vp{k}[-1].i)[-1] AS il, vq{k} AS q FROM piv),
    {s} AS (SELECT *, list_filter(q, lambda x: x.i<il.i)[-1] AS ip FROM {s}l)"""


_DIV4 = f""", {_side('be', 'h')}, {_side('bu', 'l')}, be1 AS (SELECT symbol, CASE WHEN pl.v>pp.v AND il.v<ip.v THEN 'regular_bearish' WHEN pl.v<pp.v AND il.v>ip.v THEN 'hidden_bearish' END AS t,
    CASE WHEN pl.v>pp.v AND il.v<ip.v THEN least(1e0,abs(il.v-ip.v)/20) WHEN pl.v<pp.v AND il.v>ip.v THEN 0.5e0 END AS s FROM be),
    bu1 AS (SELECT symbol, CASE WHEN pl.v<pp.v AND il.v>ip.v THEN 'regular_bullish' WHEN pl.v>pp.v AND il.v<ip.v THEN 'hidden_bullish' END AS t,
    CASE WHEN pl.v<pp.v AND il.v>ip.v THEN least(1e0,abs(il.v-ip.v)/20) WHEN pl.v>pp.v AND il.v<ip.v THEN 0.5e0 END AS s FROM bu),
    dv AS (SELECT a.symbol, CASE WHEN b.t IS NULL THEN coalesce(a.t,'none') WHEN a.t IS NULL THEN b.t WHEN a.s>=b.s THEN a.t ELSE b.t END AS divergence,
    CASE WHEN b.t IS NULL THEN coalesce(a.s,0) WHEN a.t IS NULL THEN b.s ELSE greatest(a.s,b.s) END AS divergence_strength FROM be1 a JOIN bu1 b USING (symbol))"""
cte(
    "rz",
    f"""SELECT *, CASE WHEN {lag('z')}=z THEN 0 ELSE 1 END AS nw, {over('avg(rsi)', 5)}-{over('avg(rsi)', 20)} AS td, {over('list(rsi)', 20)} AS a, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS n FROM (
    SELECT *, CASE WHEN rsi>=70 THEN 'overbought' WHEN rsi<=30 THEN 'oversold' ELSE 'neutral' END AS z FROM i_dx WHERE rsi IS NOT NULL)""",
    "i_dx",
)
cte("rz2", "SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY trade_date) AS zd FROM (SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY trade_date) AS run FROM rz)", "rz")
cte("rz3", "SELECT *, a[1:10] AS hd, list_max(a[1:10]) AS pk, list_min(a[1:10]) AS lw FROM (SELECT * FROM rz2 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC)=1)", "rz2")


@query(
    "w33_rsi_analysis",
    sql(
        "piv rz3",
        _DIV4
        + f""" SELECT symbol, {R('rsi', 4)} AS rsi, CASE WHEN rsi>=70 THEN 'overbought' WHEN rsi>=60 THEN 'strong' WHEN rsi>=40 THEN 'neutral' WHEN rsi>=30 THEN 'weak' ELSE 'oversold' END AS rsi_zone, zd AS zone_days,
        CASE WHEN n<40 THEN 'none' WHEN pk>70 AND list_min(a[list_position(hd,pk):20])<65 AND list_max(a[-5:])<pk*0.98 AND a[-1]<65 THEN 'bearish_failure'
        WHEN lw<30 AND list_max(a[list_position(hd,lw):20])>35 AND list_min(a[-5:])>lw*0.98 AND a[-1]>35 THEN 'bullish_failure' ELSE 'none' END AS failure_swing,
        {R('td', 4)} AS rsi_trend_diff, CASE WHEN td>0 THEN 'rising' ELSE 'falling' END AS rsi_trend, divergence, {R('divergence_strength', 4)} AS divergence_strength FROM rz3 LEFT JOIN dv USING (symbol)""",
    ),
)
def _(v):
    return rounded(P.rsi_analysis(trend.rsi(v.histories)), "rsi", "rsi_trend_diff", "divergence_strength", d=4)


cte(
    "bb0",
    f"""SELECT symbol, trade_date, i, close, bb_up, bb_low, bb_mid, (bb_up-bb_low)/bb_mid AS bw, close>=bb_up-(bb_up-bb_low)*0.1e0 AND close<=bb_up+(bb_up-bb_low)*0.05e0 AS tu,
    close<=bb_low+(bb_up-bb_low)*0.1e0 AND close>=bb_low-(bb_up-bb_low)*0.05e0 AS tl FROM i_w WHERE bb_mid IS NOT NULL""",
    "i_w",
)
cte(
    "bb1",
    f"""SELECT *, {over('bool_and(tu)', 5)} AND close>{lag('close', 4)} AS wu, {over('bool_and(tl)', 5)} AND close<{lag('close', 4)} AS wl, {over("max({'c': close, 'ni': -i, 'm': bb_mid})", 20)} AS tp,
    {over("min({'c': close, 'ni': i, 'm': bb_mid})", 20)} AS bt, {over('max(bb_up)', 20)} AS mu, {over('min(bb_low)', 20)} AS ml FROM bb0""",
    "bb0",
)
cte("bb2", "SELECT * FROM bb1 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC)=1", "bb1")
cte("bb3", "SELECT a.symbol, count(*) AS n, (count(*) FILTER (a.bw<b.bw)+(count(*) FILTER (a.bw=b.bw)+1)/2e0)/count(*) AS pt FROM bb0 a JOIN bb2 b USING (symbol) GROUP BY 1", "bb0", "bb2")


@query(
    "w34_bollinger_analysis",
    sql(
        "bb2 bb3",
        f"""SELECT symbol, {R('coalesce((close-bb_low)/nullif(bb_up-bb_low,0),0.5)', 4)} AS percent_b, {R('bw')} AS bandwidth, {R('pt')} AS bandwidth_pctile, n>20 AND pt<0.10 AS squeeze,
        CASE WHEN wu THEN 'upper_walk' WHEN wl THEN 'lower_walk' ELSE 'none' END AS walk, i>=39 AND tp.c>mu*0.98 AND i+tp.ni>=3 AND tp.c>tp.m AND close<=tp.m*1.02 AS m_top,
        i>=39 AND bt.c<ml*1.02 AND i-bt.ni>=3 AND bt.c<bt.m AND close>=bt.m*0.98 AS w_bottom, CASE WHEN close>bb_up THEN 'overbought' WHEN close<bb_low THEN 'oversold' ELSE 'neutral' END AS boll_zone FROM bb2 JOIN bb3 USING (symbol)""",
    ),
)
def _(v):
    df = P.bollinger_analysis(trend.bollinger(trend.with_index(v.histories)))
    return rounded(rounded(df, "percent_b", d=4), "bandwidth", "bandwidth_pctile")


cte("cc", f"SELECT * FROM (SELECT *, {over('avg(cci)', 5)}-{over('avg(cci)', 20)} AS td FROM i_w WHERE cci IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC)=1", "i_w")
_BE, _BU = "vph[-1].v>vph[-2].v AND vsh[-1].v<vsh[-2].v", "vpl[-1].v<vpl[-2].v AND vsl[-1].v>vsl[-2].v"


@query(
    "w35_cci_analysis",
    sql(
        "piv cc",
        f""" SELECT c.symbol, {R('cci', 3)} AS cci, CASE WHEN cci>200 THEN 'extreme_overbought' WHEN cci>100 THEN 'overbought' WHEN cci>-100 THEN 'normal' WHEN cci>-200 THEN 'oversold' ELSE 'extreme_oversold' END AS cci_zone,
        CASE WHEN cci>100 THEN 'above' WHEN cci<-100 THEN 'below' ELSE 'neutral' END AS centreline, {R('td', 3)} AS cci_trend_diff, CASE WHEN td>0 THEN 'rising' ELSE 'falling' END AS cci_trend,
        CASE WHEN {_BE} THEN 'regular_bearish' WHEN {_BU} THEN 'regular_bullish' ELSE 'none' END AS divergence,
        {R(f"CASE WHEN {_BE} THEN least(1e0,abs(vsh[-1].v-vsh[-2].v)/100) WHEN {_BU} THEN least(1e0,abs(vsl[-1].v-vsl[-2].v)/100) ELSE 0e0 END", 4)} AS divergence_strength FROM cc c JOIN piv p ON p.symbol=c.symbol""",
    ),
)
def _(v):
    df = P.cci_analysis(trend.cci(trend.with_index(v.histories)))
    return rounded(rounded(df, "cci", "cci_trend_diff", d=3), "divergence_strength", d=4)


def _y(c, p):
    return f"CASE WHEN coalesce({c},false) THEN {p} ELSE 0 END"


cte("bs0", f"SELECT *, {full('avg(volume)', 5, 'volume')} AS v5, {over('avg(volume)', 120)} AS v120, {full('regr_slope(ma_5,i)', 3, 'ma_5')} AS sl, {lag('ma_30', 5)} AS l30, {lag('ma_60', 10)} AS l60, {lag('ma_120', 20)} AS l120 FROM i_ma", "i_ma")
cte(
    "bs1",
    f"""SELECT *, {_y('ma_30>ma_60*0.98 AND ma_60>ma_90*0.98', 20)}+{_y('ma_30>l30 AND ma_60>l60', 10)}+{_y('ma_120>l120', 10)}+{_y('close>ma_20', 10)} AS skeleton,
    {_y('ma_5>ma_10 AND ma_10>ma_20', 15)}+{_y('sl>0', 15)} AS attack, least(10,{_y('ma_5>ma_10', 5)}+{_y('ma_10>ma_20', 3)}+{_y('ma_20>ma_30', 2)}+{_y('close>greatest(ma_5,ma_10,ma_20)', 2)}) AS perfect,
    CASE WHEN coalesce(abs(ma_5-ma_10)/greatest(ma_5,ma_10)<0.03,false) THEN 10 WHEN coalesce(abs(ma_5-ma_10)/greatest(ma_5,ma_10)<0.05,false) THEN 5 ELSE 0 END+{_y('volume<v5*0.8 AND close>ma_20', 10)} AS tolerance,
    CASE WHEN volume<v120*0.2 THEN 'thin_volume' WHEN coalesce(ma_30<ma_60,false) THEN 'broken_skeleton' ELSE '' END AS veto FROM bs0""",
    "bs0",
)
cte("bs1n", "SELECT b.* REPLACE (CASE WHEN veto='' AND (contains(n, 'ST') OR contains(n, '*')) THEN 'special_treatment' ELSE veto END AS veto) FROM bs1 b LEFT JOIN (SELECT symbol, l1||' '||name AS n FROM industry) USING (symbol)", "bs1", "industry")
for _src, _out in (("bs1", "bs3"), ("bs1n", "bs3n")):
    cte(
        _out,
        f"""SELECT symbol, trade_date, skeleton, attack, perfect, tolerance, veto, bull_score, CASE WHEN bull_score>=85 THEN 'full_bull' WHEN bull_score>=65 THEN 'accelerating' WHEN bull_score>=45 THEN 'oscillating' ELSE 'watch' END AS bull_level
        FROM (SELECT *, CASE WHEN veto<>'' THEN 0 ELSE skeleton+attack+perfect+tolerance END AS bull_score FROM {_src})""",
        _src,
    )
_BULL = ("symbol", "trade_date", "skeleton", "attack", "perfect", "tolerance", "veto", "bull_score", "bull_level")


@query("w36_bull_score", sql("bs3", "SELECT * FROM bs3"))
def _(v):
    df = P.bull_score(trend.sma(trend.with_index(v.histories)))
    return df.select(*_BULL)


@query("w36_special_treatment", sql("bs3n", "SELECT * FROM bs3n"))
def _(v):
    names = v.industry.select("symbol", F.concat_ws(" ", "l1", "name").alias("name"))
    return P.bull_score(trend.sma(trend.with_index(v.histories)).join(names, "symbol", "left"), name="name").select(*_BULL)


_WN = "OVER (PARTITION BY symbol ORDER BY trade_date)"
_WP = "OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"
cte("np0", "SELECT symbol, trade_date, i, open AS o, high AS h, low AS l, close AS c, close-open AS b FROM adj", "adj")
cte("np1", "SELECT *, " + ", ".join(f"lag({x},{n}) {_WN} AS {x}{n}" for x in "ohlcb" for n in (1, 2, 3, 4)) + f", avg(abs(b)) {_WP} AS avg_body, avg(h-l) {_WP} AS avg_range, max(i) OVER (PARTITION BY symbol) AS z FROM np0", "np0")
cte("np2", " UNION ALL ".join(f"SELECT symbol, z-i AS ago, {P.LEVEL_WEIGHT[lv]}e0 AS w, '{k}' AS pattern, CASE WHEN {up} THEN 1 WHEN {dn} THEN -1 ELSE 0 END AS hit FROM np1 WHERE i>z-60" for k, (lv, up, dn) in P.NAMED.items()), "np1")
cte("np3", "SELECT symbol, pattern, arg_min(hit, ago) AS hit, min(ago) AS ago, any_value(w) AS w FROM np2 WHERE hit<>0 GROUP BY 1,2", "np2")
cte("np4", "SELECT symbol, sum(w*hit*CASE WHEN ago=0 THEN 0.5e0 ELSE 1e0 END) AS raw, count(*) AS n, count(*) FILTER (hit>0) AS nb, count(*) FILTER (hit<0) AS nr FROM np3 GROUP BY 1", "np3")


@query(
    "w19_candle_patterns",
    sql("np4", "SELECT symbol, n AS n_patterns, nb AS n_bull, nr AS n_bear, CAST(greatest(-10,least(10,trunc(raw))) AS INT) AS pattern_score, CASE WHEN nb>nr*1.5 THEN 'bullish' WHEN nr>nb*1.5 THEN 'bearish' ELSE 'mixed' END AS bias FROM np4"),
)
def _(v):
    return P.pattern_summary(trend.with_index(v.histories))
