"""Signal-score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import panel, signals as S, trend
from barloom.plans.registry import R, Rs, cte, ema, full, lag, lead, over, query, r, rounded, sql

KEY = ("symbol", "trade_date")

cte(
    "sg1",
    f"""SELECT *, dif-dea AS h, CASE WHEN dif>dea AND dea>0 THEN 'SUPER_STRONG' WHEN dif>dea THEN 'STRONG'
    WHEN dif<dea AND dea<0 THEN 'SUPER_WEAK' ELSE 'WEAK' END AS macd_trend,
    coalesce(ma_5>ma_10 AND ma_10>ma_20 AND ma_20>ma_30 AND ma_30>ma_60, false) AS bull,
    coalesce(ma_5<ma_10 AND ma_10<ma_20 AND ma_20<ma_30 AND ma_30<ma_60, false) AS bear,
    {full('regr_slope(dif, i)', 5, 'dif')} AS dif_slope, {full('regr_r2(dif, i)', 5, 'dif')} AS dif_r2,
    avg(bb_width) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pw,
    {full('stddev_samp(close)', 30)} AS sd30, {lag('dif', 10)} AS dif10, abs(close-open) AS body, close>open AS isup,
    {lag('close', 4)} AS c4, ({lag('volume', 4)} + {lag('volume', 3)})/2e0 AS vearly,
    abs(dif-dea)/nullif(atr,0) AS golden_strength FROM ind""",
    "ind",
)
cte(
    "sg2",
    f"""SELECT *, {lag('h', 10)} AS h10, {lag('h')} AS h1, {full('stddev_samp(h)', 5, 'h', 3)} AS hsd,
    coalesce({lag('body')},0) AS pbody, coalesce({lag('isup')},false) AS pup, coalesce({lag('isup', 2)},false) AS p2up,
    (coalesce({lag('open', 2)},0)+coalesce({lag('close', 2)},0))/2e0 AS mid2, coalesce({lag('open')},0) AS po, coalesce(pc,0) AS pcz,
    {over('sum(CAST(isup AS INT))', 3)} AS ups, {full('avg(body)', 20, 'body', 5)} AS bma, least(open,close)-low AS lsh,
    high-greatest(open,close) AS ush,
    greatest(coalesce({full('quantile_cont(golden_strength, 0.75)', None, 'golden_strength', 20)}, 0.15e0), 1e-9) AS golden_norm FROM sg1""",
    "sg1",
)
cte(
    "sg3",
    """SELECT *, CASE WHEN bull AND coalesce(dif_slope>0,false) AND h>0 THEN 'STRONG_TREND' WHEN bear AND dif<=0 AND h<=0 THEN 'WEAK_TREND'
    WHEN coalesce(bb_width<pw*0.8 AND abs(h)<0.1*sd30,false) THEN 'OSCILLATION'
    WHEN NOT bull AND dif<0 AND coalesce(dif>dif10 AND h>h10,false) THEN 'BOTTOM_REVERSAL'
    WHEN bull AND coalesce((close-ma_20)/nullif(ma_20,0)>0.15,false) AND coalesce(dif<dif10 AND h<h10,false) THEN 'TOP_RISK'
    ELSE 'UNCLEAR' END AS regime,
    abs(coalesce((h-h1)/CASE WHEN hsd=0 THEN 1e-9 ELSE hsd END,0)) AS z,
    CASE WHEN coalesce(dif_slope>0,false) THEN CASE WHEN dif_r2>0.7 THEN 10 ELSE 5 END ELSE 0 END AS slope_score,
    (close-c4)/greatest(c4,1e-9) AS pct5, coalesce(CASE WHEN vearly>1e-9 THEN (volume-vearly)/vearly END,0)>0.1 AS swell,
    CASE WHEN body>0 AND ((lsh>body*2 AND ush<body*0.5) OR (ush>body*2 AND lsh<body*0.5)) THEN CASE WHEN isup THEN 1e0 ELSE -1e0 END ELSE 0e0 END AS pin,
    CASE WHEN i<2 THEN 0e0 WHEN ups=3 THEN 1e0 WHEN ups=0 THEN -1e0 ELSE 0e0 END AS run3,
    CASE WHEN p2up AND coalesce(pbody<bma*0.3,false) AND NOT isup AND close<mid2 THEN -2e0
    WHEN NOT p2up AND coalesce(pbody<bma*0.3,false) AND isup AND close>mid2 THEN 2e0
    WHEN pup AND NOT isup AND open>pcz AND close<po THEN -1e0 WHEN NOT pup AND isup AND open<pcz AND close>po THEN 1e0 ELSE 0e0 END AS turn,
    CASE WHEN coalesce(golden_strength>0,false) THEN least(1e0, golden_strength/golden_norm) ELSE 1e0 END AS vf FROM sg2""",
    "sg2",
)
cte(
    "sg4",
    f"""SELECT *, CAST(CASE WHEN i<6 THEN 0 WHEN h>0 THEN floor(15*(0.5e0+0.5e0*(z/(z+1)))) ELSE floor(8*(z/(z+1))) END AS INT) AS momentum_score,
    CASE WHEN i<5 THEN 0 WHEN pct5>0.02 AND swell THEN 10 WHEN pct5>0.02 THEN 5 WHEN pct5<-0.02 AND swell THEN -5 ELSE 0 END AS volume_price_score,
    CAST(CASE WHEN i<5 THEN 0 ELSE floor((greatest(least(({over('sum(pin)', 5)}
      + coalesce(sum(run3) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND 2 PRECEDING),0)
      + {over('sum(turn)', 5)})/10e0,1e0),-1e0)+1e0)/2e0*10) END AS INT) AS candle_score,
    {over('min(CASE WHEN macd_cross=1 THEN i END)', 30)} AS oldest FROM sg3""",
    "sg3",
)
# Divergence: extremes of DIF are detected anew every five bars on the history so far, spaced by a
# distance that follows its movement; each bar meets the nearest one that diverges from it.
cte("dvx0", f"SELECT symbol, trade_date, i, close, dif, {lag('dif')} AS dp, {lead('dif')} AS dn, {over('max(dif)')} AS hi, {over('min(dif)')} AS lo FROM i_dea", "i_dea")
cte("dvx", f"SELECT *, {over('sum(abs(dif-dp))')} AS moved FROM dvx0", "dvx0")
cte("dvp", "SELECT symbol, i, dif, CASE WHEN dif>dp THEN 1 ELSE -1 END AS sign FROM dvx WHERE (dif>dp AND dif>dn) OR (dif<dp AND dif<dn)", "dvx")
cte(
    "dvd",
    """SELECT symbol, i AS b, CASE WHEN i<19 THEN greatest(3,(i+1)//4) WHEN hi=lo THEN 11
    ELSE least(greatest(3,CAST(floor(11*(1+moved/i/(hi-lo)*10)) AS BIGINT)),greatest(10,(i+1)//5)) END AS d FROM dvx WHERE i>=5 AND i%5=0""",
    "dvx",
)
cte("dvl", "SELECT e.symbol, b, sign, any_value(d) AS d, list([p.i] ORDER BY sign*dif DESC, p.i DESC) AS ps FROM dvd e JOIN dvp p ON p.symbol=e.symbol AND p.i<e.b GROUP BY e.symbol, b, sign", "dvd", "dvp")
cte(
    "dvk",
    """SELECT symbol, b, sign, unnest(list_reduce(ps, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: abs(y-x[1])<d))=0 THEN list_concat(acc,x) ELSE acc END)) AS p FROM dvl""",
    "dvl",
)
cte(
    "dvm",
    """SELECT x.symbol, x.i, k.sign, max(k.p) AS p FROM dvx x JOIN dvk k ON k.symbol=x.symbol AND k.b=(x.i//5)*5 JOIN dvx e ON e.symbol=x.symbol AND e.i=k.p
    WHERE k.p>=k.b-22 AND x.i-k.p<=22 AND CASE WHEN k.sign=1 THEN e.close>x.close*0.98e0 AND e.dif>x.dif ELSE e.close<x.close*1.02e0 AND e.dif<x.dif END GROUP BY 1,2,3""",
    "dvx",
    "dvk",
)
cte(
    "dvs",
    """SELECT m.symbol, m.i, max(CASE WHEN sign=1 THEN m.i-p END) AS ago_t, max(CASE WHEN sign=-1 THEN m.i-p END) AS ago_b,
    max(CASE WHEN sign=1 THEN greatest(0,least(1,(x.close/e.close-x.dif/e.dif)/2)) END) AS st, max(CASE WHEN sign=-1 THEN greatest(0,least(1,(x.dif/e.dif-x.close/e.close)/2)) END) AS sb
    FROM dvm m JOIN dvx x ON x.symbol=m.symbol AND x.i=m.i JOIN dvx e ON e.symbol=m.symbol AND e.i=m.p GROUP BY 1,2""",
    "dvm",
)
cte("dvt", "SELECT symbol, trade_date, ago_t, ago_b, st, sb, coalesce(st>0.15,false) AS t, coalesce(sb>0.15 AND sb>CASE WHEN coalesce(st>0.15,false) THEN st ELSE 0 END,false) AS m FROM dvx LEFT JOIN dvs USING (symbol, i)", "dvx", "dvs")
cte(
    "div",
    """SELECT symbol, trade_date, CASE WHEN m THEN 'bottom' WHEN t THEN 'top' ELSE 'none' END AS div_type, CASE WHEN m THEN ago_b WHEN t THEN ago_t ELSE -1 END AS div_bars_ago,
    CASE WHEN m THEN sb WHEN t THEN st ELSE 0e0 END AS div_strength FROM dvt""",
    "dvt",
)
cte("sgd", "SELECT s.*, div_type, div_bars_ago, div_strength, CASE WHEN div_bars_ago>=0 THEN pow(0.5e0,div_bars_ago/8e0) ELSE 0e0 END AS div_decay FROM sg4 s JOIN div USING (symbol, trade_date)", "sg4", "div")
cte(
    "sg5",
    f"""SELECT *, CAST(floor((CASE WHEN macd_label='golden_above_zero' THEN floor(17*vf+10*vf) WHEN macd_label='golden_below_zero' THEN floor(8*vf+10*vf)
    WHEN dif>dea THEN floor(17*0.75e0*vf) ELSE 0e0 END)*coalesce(greatest(0.3e0, 1e0-(i-oldest)/30e0),1e0)) AS INT) AS golden_score,
    CASE WHEN macd_trend='SUPER_WEAK' OR regime='WEAK_TREND' OR (div_type='top' AND div_strength>0.3) THEN 'HIGH' ELSE 'LOW' END AS risk_level,
    floor(round(pc-{lag('atr')}*1.5e0,8)*100+0.5e0)/100 AS pstop FROM sgd""",
    "sgd",
)
cte(
    "sig",
    """SELECT *, CASE WHEN risk_level='HIGH' THEN 100e0 WHEN coalesce(pstop>0 AND close<pstop,false) THEN 90e0 ELSE 0e0 END AS exit_score,
    CASE WHEN coalesce(atr>0,false) THEN floor(round(close-atr*1.5e0,8)*100+0.5e0)/100 ELSE 0e0 END AS stop_loss,
    greatest(least(CASE macd_trend WHEN 'SUPER_STRONG' THEN 22 WHEN 'STRONG' THEN 13 WHEN 'WEAK' THEN 8 ELSE 0 END
      + golden_score + momentum_score + slope_score + candle_score + CASE WHEN div_type='bottom' THEN floor(11*(0.5e0+0.5e0*div_strength*div_decay)) ELSE 0 END
      - CASE WHEN div_type='top' THEN 20*div_strength*div_decay ELSE 0e0 END, 100e0), 0e0) AS score_base FROM sg5""",
    "sg5",
)
cte(
    "sigf",
    """SELECT *, greatest(least(score_base+CASE WHEN div_type='top' THEN 0 ELSE greatest(least(volume_price_score,11e0),-11e0) END,111e0),0e0) AS score,
    CASE WHEN macd_trend='SUPER_WEAK' OR (div_type='top' AND div_strength>0.3) THEN 'D' WHEN score_base>=80 THEN 'A' WHEN score_base>=60 THEN 'B' ELSE 'C' END AS level FROM sig""",
    "sig",
)


@query("w13_macd_trend", sql("sg1", "SELECT symbol, trade_date, macd_trend FROM sg1"))
def _(v):
    return trend.macd(v.histories).select(*KEY, S.macd_trend(F.col("dif"), F.col("dea")).alias("macd_trend"))


@query("w14_regime", sql("sg3", "SELECT symbol, trade_date, regime FROM sg3"))
def _(v):
    return S.regime(trend.bollinger(trend.macd(trend.sma(v.histories)))).select(*KEY, "regime")


@query("w15_momentum_score", sql("sg4", "SELECT symbol, trade_date, momentum_score FROM sg4"))
def _(v):
    return S.momentum_score(trend.macd(v.histories)).select(*KEY, "momentum_score")


@query("w16_slope_score", sql("sg3", f"SELECT symbol, trade_date, {Rs('dif_slope dif_r2')}, slope_score FROM sg3"))
def _(v):
    return rounded(S.slope_score(trend.macd(v.histories)).select(*KEY, "dif_slope", "dif_r2", "slope_score"), "dif_slope", "dif_r2")


@query("w17_volume_price_score", sql("sg4", "SELECT symbol, trade_date, volume_price_score FROM sg4"))
def _(v):
    return S.volume_price_score(trend.with_index(v.histories)).select(*KEY, "volume_price_score")


@query("w18_candle_score", sql("sg4", "SELECT symbol, trade_date, candle_score FROM sg4"))
def _(v):
    return S.candle_score(trend.with_index(v.histories)).select(*KEY, "candle_score")


@query("w20_golden_cross_score", sql("sg5", f"SELECT symbol, trade_date, {Rs('golden_norm')}, golden_score FROM sg5"))
def _(v):
    df = S.golden_score(S.golden_norm(S.oldest_cross(trend.crosses(trend.macd(trend.atr(v.histories))))))
    return df.select(*KEY, r("golden_norm").alias("golden_norm"), "golden_score")


@query("w21_divergence", sql("div", f"SELECT symbol, trade_date, div_type, CAST(div_bars_ago AS INT) AS div_bars_ago, {R('div_strength')} AS div_strength FROM div"))
def _(v):
    return rounded(S.divergence(trend.macd(v.histories)).select(*KEY, "div_type", "div_bars_ago", "div_strength"), "div_strength")


cte("lastcross", f"SELECT symbol, trade_date, i - {over('max(CASE WHEN macd_cross=1 THEN i END)')} AS bars_ago FROM i_seed", "i_seed")


@query("w22_signal_decay", sql("lastcross", f"SELECT symbol, trade_date, {R('pow(0.5e0, bars_ago/8e0)')} AS decay FROM lastcross"))
def _(v):
    df = trend.crosses(trend.macd(v.histories))
    ago = F.col("i") - F.max(F.when(F.col("macd_cross") == 1, F.col("i"))).over(panel.history())
    return df.withColumn("_ago", ago).select(*KEY, r(S.decay(F.col("_ago"))).alias("decay"))


@query("w23_risk_level", sql("sg5", "SELECT symbol, trade_date, risk_level FROM sg5"))
def _(v):
    df = S.regime(trend.bollinger(trend.macd(trend.sma(v.histories)))).withColumn("macd_trend", S.macd_trend(F.col("dif"), F.col("dea")))
    return S.risk_level(S.divergence(df)).select(*KEY, "risk_level")


@query("w24_exit_score", sql("sig", f"SELECT symbol, trade_date, exit_score, {R('stop_loss', 2)} AS stop_loss FROM sig"))
def _(v):
    df = S.regime(trend.bollinger(trend.macd(trend.sma(trend.atr(v.histories))))).withColumn("macd_trend", S.macd_trend(F.col("dif"), F.col("dea")))
    return S.exit_score(S.risk_level(S.divergence(S.last_stop(df)))).select(*KEY, "exit_score", r("stop_loss", 2).alias("stop_loss"))


@query("w25_composite_score", sql("sigf", f"SELECT symbol, trade_date, {R('score_base', 4)} AS score_base, {R('score', 4)} AS score, level FROM sigf"))
def _(v):
    return rounded(S.signals(v.histories).select(*KEY, "score_base", "score", "level"), "score_base", "score", d=4)


SIGNAL_COLUMNS = (
    "score exit_score risk_level atr macd_trend golden_score momentum_score slope_score div_type div_strength "
    "volume_price_score candle_score stop_loss level conclusion regime"
).split()


@query(
    "w26_signals",
    sql(
        "sigf",
        f"""SELECT symbol, trade_date, {R('score', 4)} AS score, exit_score, risk_level, {R('atr')} AS atr, macd_trend, golden_score, momentum_score, slope_score, div_type, {R('div_strength')} AS div_strength,
        volume_price_score, candle_score, {R('stop_loss', 2)} AS stop_loss, level, CASE level WHEN 'D' THEN 'D: top risk' WHEN 'A' THEN 'A: bullish' WHEN 'B' THEN 'B: leaning bullish' ELSE 'C: normal' END AS conclusion, regime FROM sigf""",
    ),
)
def _(v):
    df = rounded(S.signals(v.histories).select(*KEY, *SIGNAL_COLUMNS), "atr", "div_strength")
    return rounded(rounded(df, "score", d=4), "stop_loss", d=2)


@query(
    "w27_parameter_grid",
    sql(
        "sig",
        """SELECT params, level, count(*) AS n FROM (SELECT p.params, CASE WHEN macd_trend='SUPER_WEAK' OR (div_type='top' AND div_strength>0.3) THEN 'D' WHEN score_base>=p.fb THEN 'A'
        WHEN score_base>=p.b THEN 'B' ELSE 'C' END AS level FROM sig CROSS JOIN (VALUES ('loose',60,40),('strict',80,60)) p(params,fb,b)) GROUP BY 1,2""",
    ),
)
def _(v):
    sets = {"strict": S.SignalParams(), "loose": S.SignalParams(fully_bull=60, bullish=40)}
    return S.grid(v.histories, sets).groupBy("params", "level").agg(F.count(F.lit(1)).alias("n"))


#: Sets that differ in weights, thresholds, windows, stops and the distance of divergence.
TABLE = {
    "base": S.SignalParams(),
    "loose": S.SignalParams(fully_bull=60, bullish=40),
    "trend": S.SignalParams(w_trend=30, w_cross=12),
    "cross": S.SignalParams(w_cross=25, golden_bonus=5, cross_decay_days=15),
    "slow_cross": S.SignalParams(cross_decay_days=45, cross_decay_min=0.1),
    "wide_stop": S.SignalParams(atr_stop_mult=2.5),
    "tight_stop": S.SignalParams(atr_stop_mult=0.8, fully_bull=70),
    "far": S.SignalParams(divergence_distance=21, w_divergence=20),
    "near": S.SignalParams(divergence_distance=7, divergence_penalty=35),
    "strict_div": S.SignalParams(strength_floor=0.4, decay_half_life=3),
}


@query("w27_parameter_table")
def _(v):
    df = S.grid(v.histories, TABLE)
    return df.groupBy("params").agg(r(F.avg("score"), 4).alias("score"), *[F.count(F.when(F.col("level") == x, 1)).alias(f"n_{x.lower()}") for x in "ABCD"], F.count(F.when(F.col("exit_score") > 0, 1)).alias("n_exit"))


cte(
    "zap",
    """SELECT symbol, trade_date, i, dif>0 AND pd<=0 AS u, dif<0 AND pd>=0 AS d, dif>dea AND pd<=pe AND dif<0 AND dea<0 AS g FROM (
    SELECT *, lag(dif) OVER (PARTITION BY symbol ORDER BY trade_date) AS pd, lag(dea) OVER (PARTITION BY symbol ORDER BY trade_date) AS pe FROM i_dea)""",
    "i_dea",
)


@query(
    "w28_zero_axis_pattern",
    sql(
        "zap",
        """, ug AS (SELECT a.symbol, a.trade_date AS up_date, max(b.trade_date) AS golden_date FROM zap a JOIN zap b
        ON a.symbol=b.symbol AND b.trade_date<a.trade_date WHERE a.u AND b.g GROUP BY 1,2),
        ugd AS (SELECT ug.symbol, up_date, golden_date, max(b.trade_date) AS down_date FROM ug JOIN zap b ON ug.symbol=b.symbol
        AND b.trade_date<golden_date WHERE b.d GROUP BY 1,2,3)
        SELECT symbol, down_date, golden_date, up_date FROM ugd QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY up_date DESC)=1""",
    ),
)
def _(v):
    return S.zero_axis_pattern(trend.macd(v.histories))


cte(
    "wk",
    """SELECT symbol, max(trade_date) AS trade_date, arg_max(close, trade_date) AS close, row_number() OVER (PARTITION BY symbol ORDER BY max(trade_date))-1 AS i
    FROM adj GROUP BY symbol, date_trunc('week', trade_date)""",
    "adj",
)
cte("wk_d", f"SELECT *, {ema('close', 12)} - {ema('close', 26)} AS dif FROM wk", "wk")
cte("wk_e", f"SELECT *, {ema('dif', 9)} AS dea FROM wk_d", "wk_d")


@query(
    "w29_week_alignment",
    sql(
        "i_dea wk_e",
        """, d AS (SELECT symbol, arg_max(dif>dea, trade_date) AS a, count(*) AS n FROM i_dea GROUP BY symbol),
        w AS (SELECT symbol, arg_max(dif>dea, trade_date) AS b FROM wk_e GROUP BY symbol)
        SELECT d.symbol, CASE WHEN n<30 OR b IS NULL THEN 'UNKNOWN' WHEN a AND b THEN 'ALIGNED_BULL' WHEN NOT a AND NOT b THEN 'ALIGNED_BEAR'
        WHEN a THEN 'WEEKLY_BEAR_DAILY_BULL' ELSE 'WEEKLY_BULL_DAILY_BEAR' END AS alignment,
        CASE WHEN n<30 OR b IS NULL THEN 1e0 WHEN a AND b THEN 1.1e0 WHEN NOT a AND NOT b THEN 1e0 WHEN a THEN 0.5e0 ELSE 0.6e0 END AS multiplier
        FROM d LEFT JOIN w ON d.symbol=w.symbol""",
    ),
)
def _(v):
    return S.week_alignment(trend.macd(v.histories), trend.macd(panel.weekly(v.histories)))


cte(
    "xl",
    f"""SELECT *, atr>0 AS ok, floor(round(close-atr*1.5e0,8)*100+0.5e0)/100 AS sl, floor(round(close+atr*3,8)*100+0.5e0)/100 AS t1,
    floor(round(close+atr*5,8)*100+0.5e0)/100 AS t2, CASE WHEN close>={full('max(high)', 20)}*0.98e0 THEN floor(round({over('min(low)', 10)},8)*100+0.5e0)/100 END AS ts FROM i_w""",
    "i_w",
)


@query(
    "w37_exit_levels",
    sql(
        "xl",
        f"""SELECT symbol, trade_date, {R('sl', 2)} AS stop_loss, {R('t1', 2)} AS t1_target, {R('t2', 2)} AS t2_target,
        {R('CASE WHEN ok THEN ts END', 2)} AS trailing_stop, {R('(t1-close)/CASE WHEN close>sl THEN close-sl ELSE 0.01e0 END', 4)} AS exit_rrr FROM xl""",
    ),
)
def _(v):
    cols = "stop_loss t1_target t2_target trailing_stop".split()
    df = S.exit_levels(trend.atr(v.histories))
    return df.select(*KEY, *[r(c, 2).alias(c) for c in cols], r("exit_rrr", 4).alias("exit_rrr"))
