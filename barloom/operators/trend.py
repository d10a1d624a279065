"""Per-symbol indicators as window expressions; one shuffle by symbol serves them all."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from barloom.operators.panel import along_history, by_symbol, doubles_of, full, history, tail

MA_PERIODS = (5, 10, 20, 30, 60, 90, 120, 200)
BLOCK = 1000


def with_index(df: DataFrame) -> DataFrame:
    """Zero-based row number `i` within the symbol."""
    return df if "i" in df.columns else df.withColumn("i", F.row_number().over(by_symbol()) - 1)


def block_size(*decays: float) -> int:
    """Rows of a block short enough for the powers of each decay to stay in range."""
    return max(1, min(BLOCK, *(int(600 / -math.log(decay)) for decay in decays)))


def recur(x: np.ndarray, decay: float, gain: float, seed: float, start: int) -> np.ndarray:
    """`recurrences` of one symbol, by the same closed form; a missing value adds nothing."""
    out, carry, size = np.full(len(x), np.nan), 0.0, block_size(decay)
    terms = gain * x[start:]
    terms[:1] = seed
    terms = np.where(np.isnan(terms), 0.0, terms)
    for at in range(0, len(terms), size):
        k = np.arange(min(size, len(terms) - at))
        y = np.power(decay, k) * np.cumsum(terms[at : at + size] * np.power(1.0 / decay, k)) + np.power(decay, k + 1) * carry
        out[start + at : start + at + len(k)], carry = y, y[-1]
    return out


def recurrences(df: DataFrame, specs: list[tuple[str, Column, float, float, Column, int]]) -> DataFrame:
    """Linear recurrences as prefix sums, several at once: (out, x, decay, gain, seed, start)
    gives y[start] = seed and y[i] = decay*y[i-1] + gain*x[i] afterwards.

    The closed form holds inside a block of rows that is short enough for its powers to stay
    in range; the ends of all earlier blocks are carried over, so any decay between 0 and 1
    will do.  All recurrences of one call share two window passes."""
    if any(not 0 < decay < 1 for _, _, decay, *_ in specs):
        raise ValueError("a decay lies between 0 and 1")
    size = block_size(*(decay for _, _, decay, *_ in specs))
    df = with_index(df).withColumn("_blk", F.floor(F.col("i") / size))
    k = F.col("i") % size
    term = lambda x, d, g, seed, st: F.when(F.col("i") == st, seed).when(F.col("i") > st, g * x) * F.pow(F.lit(1.0 / d), k)
    df = df.withColumns({f"_g_{o}": term(x, d, g, seed, st) for o, x, d, g, seed, st in specs})
    block = W.partitionBy("symbol", "_blk").orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumns({f"_l_{o}": F.pow(F.lit(d), k) * F.sum(f"_g_{o}").over(block) for o, _, d, *_ in specs})
    before = by_symbol().rowsBetween(W.unboundedPreceding, -1)
    # one element for each full block of the symbol's calendar, oldest first
    ends = lambda o: F.collect_list(F.when(k == size - 1, F.col(f"_l_{o}"))).over(before)
    df = df.withColumns({f"_c_{o}": ends(o) for o, *_ in specs})
    carry = lambda o, d: F.aggregate(f"_c_{o}", F.lit(0.0), lambda y, end: y * F.lit(d**size) + end)
    df = df.withColumns(
        {
            o: F.when(
                F.col("i") >= st,
                F.coalesce(F.col(f"_l_{o}"), F.lit(0.0)) + F.pow(F.lit(d), k + 1) * carry(o, d),
            )
            for o, _, d, _, _, st in specs
        }
    )
    return df.drop("_blk", *[f"_{p}_{o}" for o, *_ in specs for p in "glc"])


def column_of(x: np.ndarray) -> pa.Array:
    return pa.array(x, mask=np.isnan(x))


def moved(x: np.ndarray, n: int = 1) -> np.ndarray:
    """The value n rows back."""
    return np.r_[np.full(min(n, len(x)), np.nan), x[: max(0, len(x) - n)]]


def total(x: np.ndarray, n: int) -> np.ndarray:
    """Sum of the last n values, oldest first; NaN until there are n."""
    padded, out = np.r_[np.full(n - 1, np.nan), x], np.zeros(len(x))
    for k in range(n):
        out += padded[k : k + len(x)]
    return out


def frames(x: np.ndarray, n: int) -> np.ndarray:
    """The last n values of each row."""
    return np.lib.stride_tricks.sliding_window_view(np.r_[np.full(n - 1, np.nan), x], n)


def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b; missing where b is zero."""
    return np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0)


def recurrence(df: DataFrame, out: str, x: Column, decay: float, gain: float, seed: Column, start: int = 0) -> DataFrame:
    return recurrences(df, [(out, x, decay, gain, seed, start)])


def ema(df: DataFrame, out: str, src: str, span: int) -> DataFrame:
    """Exponential mean seeded with the first value."""
    a = 2.0 / (span + 1)
    return recurrence(df, out, F.col(src), 1 - a, a, F.col(src))


def wilder(df: DataFrame, out: str, src: str, n: int, start: int) -> DataFrame:
    """Wilder smoothing seeded with the mean of the first n values, at row `start`."""
    return recurrence(df, out, F.col(src), 1 - 1.0 / n, 1.0 / n, F.avg(src).over(tail(n)), start)


def sma(df: DataFrame, periods=MA_PERIODS, src: str = "close", min_periods: int | None = None) -> DataFrame:
    """Simple means `ma_<n>`; strict windows unless `min_periods` is given."""
    return df.withColumns({f"ma_{p}": full(F.avg(src), p, min_periods, src) for p in periods})


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """`dif`, `dea` and the doubled histogram `macd_hist`."""
    df = ema(ema(df, "_ef", "close", fast), "_es", "close", slow)
    df = ema(df.withColumn("dif", F.col("_ef") - F.col("_es")), "dea", "dif", signal)
    return df.withColumn("macd_hist", 2 * (F.col("dif") - F.col("dea"))).drop("_ef", "_es")


def crosses(df: DataFrame) -> DataFrame:
    """`macd_cross` (1 golden, -1 dead, 0) and the label against the zero axis."""
    if "macd_cross" not in df.columns:
        pdea = F.coalesce(F.lag("dea").over(by_symbol()), F.lit(0.0))
        pdif = F.coalesce(F.lag("dif").over(by_symbol()), pdea)
        golden = (F.col("dif") > F.col("dea")) & (pdif <= pdea)
        dead = (F.col("dif") < F.col("dea")) & (pdif >= pdea)
        df = df.withColumn("macd_cross", F.when(golden, 1).when(dead, -1).otherwise(0))
    return df.withColumn(
        "macd_label",
        F.when((F.col("macd_cross") == 1) & (F.col("dif") > 0) & (F.col("dea") > 0), "golden_above_zero")
        .when(F.col("macd_cross") == 1, "golden_below_zero")
        .when((F.col("macd_cross") == -1) & (F.col("dif") < 0) & (F.col("dea") < 0), "dead_below_zero")
        .when(F.col("macd_cross") == -1, "dead_above_zero")
        .when(F.col("dif") > 0, "bull")
        .otherwise("bear"),
    )


def true_range(df: DataFrame) -> DataFrame:
    pc = F.lag("close").over(by_symbol())
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))
    return df.withColumn("tr", F.when(pc.isNotNull(), tr))


def atr(df: DataFrame, n: int = 14) -> DataFrame:
    """Wilder `atr`; first value at row n."""
    return wilder(true_range(df), "atr", "tr", n, n).drop("tr")


def atr_simple(df: DataFrame, n: int = 14) -> DataFrame:
    return true_range(df).withColumn("atr_simple", full(F.avg("tr"), n, src="tr")).drop("tr")


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """Wilder `rsi`, 0 when nothing moved."""
    d = F.col("close") - F.lag("close").over(by_symbol())
    df = df.withColumn("_up", F.greatest(d, F.lit(0.0))).withColumn("_dn", F.greatest(-d, F.lit(0.0)))
    df = df.withColumns({c: F.when(F.lag("close").over(by_symbol()).isNotNull(), F.col(c)) for c in ("_up", "_dn")})
    df = wilder(wilder(df, "_au", "_up", n, n), "_ad", "_dn", n, n)
    tot = F.col("_au") + F.col("_ad")
    return df.withColumn("rsi", F.when(tot.isNotNull(), F.coalesce(F.try_divide(100 * F.col("_au"), tot), F.lit(0.0)))).drop(
        "_up", "_dn", "_au", "_ad"
    )


def adx(df: DataFrame, n: int = 14) -> DataFrame:
    """Average directional index; first value at row 2n-1."""
    up = F.col("high") - F.lag("high").over(by_symbol())
    dn = F.lag("low").over(by_symbol()) - F.col("low")
    df = true_range(df).withColumn("_pdm", F.when((up > dn) & (up > 0), up).when(up.isNotNull(), 0.0))
    df = df.withColumn("_mdm", F.when((dn > up) & (dn > 0), dn).when(dn.isNotNull(), 0.0))
    for src, out in (("tr", "_str"), ("_pdm", "_sp"), ("_mdm", "_sm")):
        df = recurrence(df, out, F.col(src), 1 - 1.0 / n, 1.0, F.sum(src).over(tail(n - 1)), n - 1)
    p, m = F.try_divide(F.col("_sp"), F.col("_str")), F.try_divide(F.col("_sm"), F.col("_str"))
    dx = F.when(F.col("i") >= n, F.coalesce(F.try_divide(100 * F.abs(p - m), p + m), F.lit(0.0)))
    df = wilder(df.withColumn("_dx", dx), "adx", "_dx", n, 2 * n - 1)
    return df.drop("tr", "_pdm", "_mdm", "_str", "_sp", "_sm", "_dx")


def stochastic(df: DataFrame, k: int = 9, smooth: int = 3, d: int = 3) -> DataFrame:
    """Slow stochastic `slow_k`, `slow_d`; a flat range counts as 0."""
    hh, ll = full(F.max("high"), k), full(F.min("low"), k)
    df = df.withColumn("_fk", F.when(hh.isNotNull(), F.coalesce(F.try_divide(100 * (F.col("close") - ll), hh - ll), F.lit(0.0))))
    df = df.withColumn("slow_k", full(F.avg("_fk"), smooth, src="_fk"))
    return df.withColumn("slow_d", full(F.avg("slow_k"), d, src="slow_k")).drop("_fk")


def kdj(df: DataFrame, k: int = 9, d: int = 3, j_weights: tuple[int, int] = (-2, 3)) -> DataFrame:
    """Raw K, D = mean of K, J = a*K + b*D.  The default weights are (-2, 3), i.e. 3D-2K;
    pass (3, -2) for the textbook form.  Slopes are one-row changes."""
    hh, ll = full(F.max("high"), k), full(F.min("low"), k)
    df = df.withColumn("kdj_k", F.try_divide(100 * (F.col("close") - ll), hh - ll))
    df = df.withColumn("kdj_d", full(F.avg("kdj_k"), d, src="kdj_k"))
    df = df.withColumn("kdj_j", j_weights[0] * F.col("kdj_k") + j_weights[1] * F.col("kdj_d"))
    return df.withColumns(
        {f"kdj_{c}_slope": F.col(f"kdj_{c}") - F.lag(f"kdj_{c}").over(by_symbol()) for c in ("k", "d", "j")}
    )


def cci(df: DataFrame, n: int = 20) -> DataFrame:
    """Commodity channel index with the mean absolute deviation of the same window."""
    df = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    m = full(F.avg("_tp"), n, src="_tp")
    # At most n elements per row: the frame, not the group, is collected.
    win = F.collect_list("_tp").over(tail(n))
    df = df.withColumn("_m", m).withColumn("_win", win)
    dev = F.aggregate("_win", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_m"))) / n
    return df.withColumn(
        "cci",
        F.when(F.col("_m").isNotNull(), F.coalesce(F.try_divide(F.col("_tp") - F.col("_m"), 0.015 * dev), F.lit(0.0))),
    ).drop("_tp", "_m", "_win")


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """Bands on the population deviation; bandwidth relative to the close."""
    mid, sd = full(F.avg("close"), n), full(F.stddev_pop("close"), n)
    return df.withColumns({"bb_mid": mid, "bb_up": mid + k * sd, "bb_low": mid - k * sd}).withColumn(
        "bb_width", F.try_divide(F.col("bb_up") - F.col("bb_low"), F.col("close"))
    )


def turnover_columns(df: DataFrame) -> DataFrame:
    """Lagged 20-row mean amount (known before today's open) and the amplitude."""
    amt = F.coalesce("amount", F.col("close") * F.col("volume"))
    df = df.withColumn("amount", amt)
    return df.withColumn("amount_ma20", full(F.avg("amount"), 20, src="amount", to=-1)).withColumn(
        "amplitude", F.try_divide(F.col("high") - F.col("low"), F.col("close"))
    )


_WALKED = [*[f"ma_{p}" for p in MA_PERIODS], *"bb_mid bb_up bb_low bb_width amount_ma20 atr rsi adx cci slow_k slow_d dif dea macd_hist amplitude".split()]
INDICATORS = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("macd_cross", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in _WALKED]])


def indicator_rows(rows: pa.Table) -> dict[str, pa.Array]:
    """INDICATORS of a symbol's bars in order of date; each as the operator of its name gives it."""
    h, lo, c, amount = (doubles_of(rows, x) for x in ("high", "low", "close", "amount"))
    n, d, rows_ = 14, 1 - 1.0 / 14, np.arange(len(c))
    pc, out = moved(c), {f"ma_{p}": total(c, p) / p for p in MA_PERIODS}
    def first(x: np.ndarray, k: int, mean: bool = True) -> float:
        """Sum or mean of rows 1 to k, missing values left out."""
        there = x[1 : k + 1][~np.isnan(x[1 : k + 1])]
        return np.cumsum(there)[-1] / (len(there) if mean else 1) if len(there) else np.nan

    some = lambda x: np.where(np.isnan(pc), np.nan, x)
    with np.errstate(all="ignore"):
        mid, sd = out["ma_20"], np.where(frames(c, 20).max(axis=1) == frames(c, 20).min(axis=1), 0.0, frames(c, 20).std(axis=1))
        out |= {"bb_mid": mid, "bb_up": mid + 2.0 * sd, "bb_low": mid - 2.0 * sd, "amount_ma20": moved(total(amount, 20) / 20)}
        up, dn = h - moved(h), moved(lo) - lo
        tr = some(np.fmax(np.fmax(h - lo, np.abs(h - pc)), np.abs(lo - pc)))
        rise, fall = some(np.fmax(c - pc, 0.0)), some(np.fmax(pc - c, 0.0))
        pdm, mdm = some(np.where((up > dn) & (up > 0), up, 0.0)), some(np.where((dn > up) & (dn > 0), dn, 0.0))
        out["atr"], au, ad = (recur(x, d, 1.0 / n, first(x, n), n) for x in (tr, rise, fall))
        s_tr, s_p, s_m = (recur(x, d, 1.0, first(x, n - 1, False), n - 1) for x in (tr, pdm, mdm))
        out["rsi"] = np.where(np.isnan(au + ad), np.nan, np.nan_to_num(over(100 * au, au + ad), nan=0.0))
        p, m = over(s_p, s_tr), over(s_m, s_tr)
        dx = np.where(rows_ >= n, np.nan_to_num(over(100 * np.abs(p - m), p + m), nan=0.0), np.nan)
        out["adx"] = recur(dx, d, 1.0 / n, np.cumsum(dx[n : 2 * n])[-1] / n if len(dx) >= 2 * n else np.nan, 2 * n - 1)
        tp = (h + lo + c) / 3
        mean = total(tp, 20) / 20
        dev = np.zeros(len(c))
        for k in range(19, -1, -1):
            dev += np.abs(moved(tp, k) - mean)
        out["cci"] = np.where(np.isnan(mean), np.nan, np.nan_to_num(over(tp - mean, 0.015 * (dev / 20)), nan=0.0))
        hh, ll = frames(h, 9).max(axis=1), frames(lo, 9).min(axis=1)
        fast_k = np.where(np.isnan(hh), np.nan, np.nan_to_num(over(100 * (c - ll), hh - ll), nan=0.0))
        out["slow_k"] = total(fast_k, 3) / 3
        out["slow_d"] = total(out["slow_k"], 3) / 3
        ema_ = lambda x, span: recur(x, 1 - 2.0 / (span + 1), 2.0 / (span + 1), x[0], 0)
        out["dif"] = ema_(c, 12) - ema_(c, 26)
        out["dea"] = recur(out["dif"], 0.8, 0.2, out["dif"][0], 0)
        out["macd_hist"] = 2 * (out["dif"] - out["dea"])
        out["bb_width"], out["amplitude"] = over(out["bb_up"] - out["bb_low"], c), over(h - lo, c)
        dif, dea, was_dea = out["dif"], out["dea"], np.nan_to_num(moved(out["dea"]), nan=0.0)
        was_dif = np.where(np.isnan(moved(dif)), was_dea, moved(dif))
        cross = np.select([(dif > dea) & (was_dif <= was_dea), (dif < dea) & (was_dif >= was_dea)], [1, -1], 0)
    return {"i": pa.array(rows_, pa.int32()), "macd_cross": pa.array(cross, pa.int32()), **{k: column_of(x) for k, x in out.items()}}


def indicators(bars: DataFrame) -> DataFrame:
    """The shared indicator panel: all of the above, arranged so that everything that can
    share a window pass does."""
    lag = lambda c: F.lag(c).over(by_symbol())
    n, d = 14, 1 - 1.0 / 14
    df = with_index(bars)
    df = df.withColumns(
        {
            **{f"ma_{p}": full(F.avg("close"), p) for p in MA_PERIODS},
            "_pc": lag("close"), "_ph": lag("high"), "_pl": lag("low"),
            "_hh": full(F.max("high"), 9), "_ll": full(F.min("low"), 9),
            "bb_mid": full(F.avg("close"), 20), "_sd": full(F.stddev_pop("close"), 20),
            "amount_ma20": full(F.avg("amount"), 20, src="amount", to=-1),
        }
    )
    h, lo, c, pc = F.col("high"), F.col("low"), F.col("close"), F.col("_pc")
    up, dn = h - F.col("_ph"), F.col("_pl") - lo
    some = lambda x: F.when(pc.isNotNull(), x)
    df = df.withColumns(
        {
            "_tr": some(F.greatest(h - lo, F.abs(h - pc), F.abs(lo - pc))),
            "_up": some(F.greatest(c - pc, F.lit(0.0))), "_dn": some(F.greatest(pc - c, F.lit(0.0))),
            "_pdm": some(F.when((up > dn) & (up > 0), up).otherwise(0.0)), "_mdm": some(F.when((dn > up) & (dn > 0), dn).otherwise(0.0)),
            "_tp": (h + lo + c) / 3,
            "_fk": F.when(F.col("_hh").isNotNull(), F.coalesce(F.try_divide(100 * (c - F.col("_ll")), F.col("_hh") - F.col("_ll")), F.lit(0.0))),
            "bb_up": F.col("bb_mid") + 2.0 * F.col("_sd"), "bb_low": F.col("bb_mid") - 2.0 * F.col("_sd"),
        }
    ).withColumn("bb_width", F.try_divide(F.col("bb_up") - F.col("bb_low"), c))
    df = df.withColumns(
        {
            **{f"_a{x}": F.avg(x).over(tail(n)) for x in ("_tr", "_up", "_dn")},
            **{f"_s{x}": F.sum(x).over(tail(n - 1)) for x in ("_tr", "_pdm", "_mdm")},
            "_m": full(F.avg("_tp"), 20, src="_tp"), "_win": F.collect_list("_tp").over(tail(20)),
            "slow_k": full(F.avg("_fk"), 3, src="_fk"),
        }
    )
    fast, slow = 2.0 / 13, 2.0 / 27
    df = recurrences(
        df,
        [
            ("_ef", c, 1 - fast, fast, c, 0), ("_es", c, 1 - slow, slow, c, 0),
            ("atr", F.col("_tr"), d, 1.0 / n, F.col("_a_tr"), n), ("_au", F.col("_up"), d, 1.0 / n, F.col("_a_up"), n), ("_ad", F.col("_dn"), d, 1.0 / n, F.col("_a_dn"), n),
            ("_str", F.col("_tr"), d, 1.0, F.col("_s_tr"), n - 1), ("_sp", F.col("_pdm"), d, 1.0, F.col("_s_pdm"), n - 1), ("_sm", F.col("_mdm"), d, 1.0, F.col("_s_mdm"), n - 1),
        ],
    )
    p, m, tot = F.try_divide(F.col("_sp"), F.col("_str")), F.try_divide(F.col("_sm"), F.col("_str")), F.col("_au") + F.col("_ad")
    dev = F.aggregate("_win", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_m"))) / 20
    df = df.withColumns(
        {
            "dif": F.col("_ef") - F.col("_es"),
            "rsi": F.when(tot.isNotNull(), F.coalesce(F.try_divide(100 * F.col("_au"), tot), F.lit(0.0))),
            "_dx": F.when(F.col("i") >= n, F.coalesce(F.try_divide(100 * F.abs(p - m), p + m), F.lit(0.0))),
            "cci": F.when(F.col("_m").isNotNull(), F.coalesce(F.try_divide(F.col("_tp") - F.col("_m"), 0.015 * dev), F.lit(0.0))),
        }
    )
    df = df.withColumns({"_adx": F.avg("_dx").over(tail(n)), "slow_d": full(F.avg("slow_k"), 3, src="slow_k")})
    df = recurrences(df, [("dea", F.col("dif"), 0.8, 0.2, F.col("dif"), 0), ("adx", F.col("_dx"), d, 1.0 / n, F.col("_adx"), 2 * n - 1)])
    df = df.withColumn("macd_hist", 2 * (F.col("dif") - F.col("dea"))).withColumn("amplitude", F.try_divide(h - lo, c))
    return crosses(df).drop(*[x for x in df.columns if x.startswith("_")])


def vol_regime(df: DataFrame) -> DataFrame:
    """ATR relative to its 30-row mean, combined with trend strength."""
    df = df if "_atr30" in df.columns else df.withColumn("_atr30", full(F.avg("atr"), 30, src="atr"))
    return df.withColumn("atr_ratio", F.try_divide(F.col("atr"), F.col("_atr30"))).drop("_atr30").withColumn(
        "vol_regime",
        F.when(F.col("atr_ratio").isNull(), "NORMAL")
        .when((F.col("atr_ratio") > 1.3) & (F.col("adx") > 25), "HIGH_VOL_TREND")
        .when((F.col("atr_ratio") < 0.7) & (F.coalesce("adx", F.lit(0.0)) < 20), "LOW_VOL_REVERSAL")
        .otherwise("NORMAL"),
    )


def drawdown(df: DataFrame, value: str = "close") -> DataFrame:
    return df.withColumn("drawdown", F.try_divide(F.col(value), F.max(value).over(history())) - 1)


def forward_return(df: DataFrame, horizons=(1, 5, 10, 20), fill_zero: bool = False) -> DataFrame:
    out = df
    for h in horizons:
        r = F.try_divide(F.lead("close", h).over(by_symbol()), F.col("close")) - 1
        out = out.withColumn(f"fwd_{h}", F.coalesce(r, F.lit(0.0)) if fill_zero else r)
    return out
