"""Per-symbol indicator queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import panel, trend
from barloom.plans.registry import R, Rs, cte, ema, full, lag, lead, over, query, r, rounded, sql

KEY = ("symbol", "trade_date")
MAS = " ".join(f"ma_{p}" for p in trend.MA_PERIODS)


def pick(df, cols: str, d: int = 6):
    return rounded(df.select(*KEY, *cols.split()), *cols.split(), d=d)


@query("w01_moving_averages", sql("i_ma", f"SELECT symbol, trade_date, {Rs(MAS)} FROM i_ma"))
def _(v):
    return pick(trend.sma(v.histories), MAS)


_P = (5, 20, 60)


@query(
    "w01_moving_averages_min_periods",
    sql("adj", "SELECT symbol, trade_date, " + ", ".join(f"{R(full('avg(close)', p, mp=1))} AS ma_{p}" for p in _P) + " FROM adj"),
)
def _(v):
    return pick(trend.sma(v.histories, _P, min_periods=1), "ma_5 ma_20 ma_60")


@query("w02_ema", sql("adj", f"SELECT symbol, trade_date, {R(ema('close', 12))} AS ema_12, {R(ema('close', 26))} AS ema_26 FROM adj"))
def _(v):
    return pick(trend.ema(trend.ema(v.histories, "ema_12", "close", 12), "ema_26", "close", 26), "ema_12 ema_26")


@query("w03_macd", sql("i_x", f"SELECT symbol, trade_date, {Rs('dif dea macd_hist')} FROM i_x"))
def _(v):
    return pick(trend.macd(v.histories), "dif dea macd_hist")


@query("w04_macd_crosses", sql("i_seed", "SELECT symbol, trade_date, macd_cross, macd_label FROM i_seed"))
def _(v):
    return trend.crosses(trend.macd(v.histories)).select(*KEY, "macd_cross", "macd_label")


@query("w05_atr", sql("i_w", f"SELECT symbol, trade_date, {R('atr')} AS atr, {R(full('avg(tr)', 14, 'tr'))} AS atr_simple FROM i_w"))
def _(v):
    return pick(trend.atr_simple(trend.atr(v.histories)), "atr atr_simple")


@query("w06_adx", sql("ind", f"SELECT symbol, trade_date, {R('adx')} AS adx FROM ind"))
def _(v):
    return pick(trend.adx(trend.with_index(v.histories)), "adx")


@query("w07_rsi", sql("i_dx", f"SELECT symbol, trade_date, {R('rsi')} AS rsi FROM i_dx"))
def _(v):
    return pick(trend.rsi(v.histories), "rsi")


@query("w08_stochastic", sql("i_dxs", f"SELECT symbol, trade_date, {Rs('slow_k slow_d')} FROM i_dxs"))
def _(v):
    return pick(trend.stochastic(v.histories), "slow_k slow_d")


cte("kdj_k", f"SELECT *, 100*(close-{full('min(low)', 9)})/nullif({full('max(high)', 9)}-{full('min(low)', 9)},0) AS kdj_k FROM adj", "adj")
cte("kdj_d", f"SELECT *, {full('avg(kdj_k)', 3, 'kdj_k')} AS kdj_d FROM kdj_k", "kdj_k")
cte(
    "kdj",
    f"""SELECT *, kdj_k-{lag('kdj_k')} AS kdj_k_slope, kdj_d-{lag('kdj_d')} AS kdj_d_slope,
    kdj_j-{lag('kdj_j')} AS kdj_j_slope FROM (SELECT *, 3*kdj_d-2*kdj_k AS kdj_j FROM kdj_d)""",
    "kdj_d",
)
KDJ = "kdj_k kdj_d kdj_j kdj_k_slope kdj_d_slope kdj_j_slope"


@query("w09_kdj", sql("kdj", f"SELECT symbol, trade_date, {Rs(KDJ)} FROM kdj"))
def _(v):
    return pick(trend.kdj(v.histories), KDJ)


@query("w10_cci", sql("i_w", f"SELECT symbol, trade_date, {R('cci', 5)} AS cci FROM i_w"))
def _(v):
    return pick(trend.cci(v.histories), "cci", 5)


@query("w11_bollinger", sql("i_dx", f"SELECT symbol, trade_date, {Rs('bb_up bb_mid bb_low bb_width', 5)} FROM i_dx"))
def _(v):
    return pick(trend.bollinger(v.histories), "bb_up bb_mid bb_low bb_width", 5)


@query("w12_amount_amplitude", sql("i_dx", f"SELECT symbol, trade_date, {R('amount', 2)} AS amount, {R('amount_ma20', 4)} AS amount_ma20, {R('amplitude')} AS amplitude FROM i_dx"))
def _(v):
    df = trend.turnover_columns(v.histories)
    return df.select(*KEY, r("amount", 2).alias("amount"), r("amount_ma20", 4).alias("amount_ma20"), r("amplitude").alias("amplitude"))


cte("volreg", f"SELECT *, atr/nullif({full('avg(atr)', 30, 'atr')},0) AS atr_ratio FROM ind", "ind")


@query(
    "w30_volatility_regime",
    sql(
        "volreg",
        f"""SELECT symbol, trade_date, {R('atr_ratio')} AS atr_ratio, CASE WHEN atr_ratio IS NULL THEN 'NORMAL'
        WHEN atr_ratio>1.3 AND adx>25 THEN 'HIGH_VOL_TREND' WHEN atr_ratio<0.7 AND coalesce(adx,0)<20 THEN 'LOW_VOL_REVERSAL'
        ELSE 'NORMAL' END AS vol_regime FROM volreg""",
    ),
)
def _(v):
    df = trend.vol_regime(trend.adx(trend.atr(v.histories)))
    return df.select(*KEY, r("atr_ratio").alias("atr_ratio"), "vol_regime")


@query("w40_drawdown", sql("adj", f"SELECT symbol, trade_date, {R('close/' + over('max(close)') + '-1')} AS drawdown FROM adj"))
def _(v):
    return pick(trend.drawdown(v.histories), "drawdown")


_H = (1, 5, 10, 20)


@query(
    "w41_forward_returns",
    sql(
        "adj",
        "SELECT symbol, trade_date, "
        + ", ".join(f"{R(lead('close', h) + '/close-1')} AS fwd_{h}, coalesce({R(lead('close', h) + '/close-1')},0) AS fwd0_{h}" for h in _H)
        + " FROM adj",
    ),
)
def _(v):
    df = trend.forward_return(v.histories)
    out = rounded(df, *[f"fwd_{h}" for h in _H])
    return out.select(*KEY, *[f"fwd_{h}" for h in _H], *[F.coalesce(f"fwd_{h}", F.lit(0.0)).alias(f"fwd0_{h}") for h in _H])


@query(
    "t02_tail_rows",
    sql("adj", f"SELECT symbol, trade_date, {R('close')} AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS rn FROM adj) WHERE rn<=21"),
)
def _(v):
    return pick(panel.tail_n(v.histories, 21), "close")


@query(
    "t05_latest_snapshot",
    sql("adj", f"SELECT symbol, max(trade_date) AS trade_date, {R('arg_max(close, trade_date)')} AS close, arg_max(volume, trade_date) AS volume FROM adj GROUP BY symbol"),
)
def _(v):
    return panel.last_rows(v.histories).select("symbol", "trade_date", r("close").alias("close"), "volume")


@query(
    "weekly_bars",
    sql(
        "adj",
        f"""SELECT symbol, CAST(date_trunc('week', trade_date) AS DATE) AS week, {R('arg_max(close, trade_date)')} AS close,
        {R('max(high)')} AS high, {R('min(low)')} AS low, CAST(sum(volume) AS BIGINT) AS volume, max(trade_date) AS trade_date FROM adj GROUP BY 1,2""",
    ),
)
def _(v):
    return rounded(panel.weekly(v.histories), "close", "high", "low")
