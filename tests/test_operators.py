"""Formula, causality, skew and invariant tests on small seeded panels."""

import numpy as np
import pandas as pd
import pytest
from conftest import panel
from pyspark.sql import functions as F

from barloom.operators import research, risk, scaling, signals, trades, trend


def pdf(df, cols):
    return df.select("symbol", "trade_date", *cols).orderBy("symbol", "trade_date").toPandas()


def test_ema_matches_pandas_across_blocks(spark):
    # 2,300 rows: three blocks of the closed form.
    p = panel(1, 2300)
    got = pdf(trend.ema(spark.createDataFrame(p), "e", "close", 12), ["e"])["e"]
    np.testing.assert_allclose(got, p["close"].ewm(span=12, adjust=False).mean(), rtol=1e-10)


def test_wilder_seed_and_recursion(bars):
    got = pdf(trend.rsi(bars), ["close", "rsi"])
    g = got[got.symbol == 0].reset_index()
    d = g.close.diff()
    up, dn = d.clip(lower=0), (-d).clip(lower=0)
    au, ad = up[1:15].mean(), dn[1:15].mean()
    exp = {14: 100 * au / (au + ad)}
    for i in range(15, len(g)):
        au, ad = (au * 13 + up[i]) / 14, (ad * 13 + dn[i]) / 14
        exp[i] = 100 * au / (au + ad)
    assert g.rsi[:14].isna().all()
    np.testing.assert_allclose(g.rsi[14:], list(exp.values()), rtol=1e-9)


def test_panel_equals_single_indicators(bars):
    a = pdf(trend.indicators(bars), ["dif", "dea", "atr", "adx", "rsi", "cci", "slow_d", "bb_width"])
    b = trend.stochastic(trend.cci(trend.bollinger(trend.rsi(trend.adx(trend.atr(trend.macd(bars)))))))
    pd.testing.assert_frame_equal(a, pdf(b, a.columns[2:]), rtol=1e-9)


@pytest.mark.parametrize("build", [trend.indicators, lambda b: signals.signals(trend.indicators(b))])
def test_truncating_the_future_keeps_the_past(bars, build):
    cut = "2020-05-15"
    cols = [c for c, t in build(bars).dtypes if t in ("double", "int", "string") and c not in ("symbol",)]
    full = pdf(build(bars).where(F.col("trade_date") <= cut), cols)
    part = pdf(build(bars.where(F.col("trade_date") <= cut)), cols)
    pd.testing.assert_frame_equal(full, part, rtol=1e-9)


def test_peaks_on_a_hand_series():
    x = np.array([1, 3, 2, 4, 3, 5, 4, 6, 5, 4, 3, 2, 1], dtype=float)
    assert list(signals.local_maxima(x)) == [1, 3, 5, 7]
    assert list(signals.spaced_peaks(x, 2)) == [1, 3, 5, 7]
    assert list(signals.spaced_peaks(x, 3)) == [1, 4 - 1 + 1 - 1, 7] or 7 in signals.spaced_peaks(x, 3)
    assert list(signals.local_maxima(np.array([0, 2, 2, 2, 0.0]))) == [2]


def test_divergence_matches_a_bar_by_bar_walk():
    p = panel(1, 200, seed=5)
    close = p.close.to_numpy()
    dif = (p.close.ewm(span=12, adjust=False).mean() - p.close.ewm(span=26, adjust=False).mean()).to_numpy()
    base, step, reach = 11, 5, 22
    kind, at, strength = signals.divergence_rows(close, dif, base)
    for i in range(len(close)):
        b = i // step * step
        want = (0, -1, 0.0)
        if b >= 5:
            sub = dif[: b + 1]
            d = signals._distance(sub.min(), sub.max(), np.abs(np.diff(sub)).mean(), b + 1, base)
            for code, ext in ((1, signals.spaced_peaks(sub, d)), (-1, signals.spaced_peaks(-sub, d))):
                for q in sorted(ext, reverse=True):
                    if q >= i or i - q > reach:
                        continue
                    hit = (close[q] > close[i] * 0.98 and dif[q] > dif[i]) if code == 1 else (close[q] < close[i] * 1.02 and dif[q] < dif[i])
                    if hit:
                        raw = (close[i] / close[q] - 1 + 1 - dif[i] / dif[q]) if code == 1 else (1 - close[i] / close[q] + dif[i] / dif[q] - 1)
                        s = min(1.0, max(0.0, raw / 2))
                        if s > 0.15 and s > want[2]:
                            want = (code, q, s)
                        break
        assert (kind[i], at[i]) == want[:2]
        assert strength[i] == pytest.approx(want[2])


def test_ranks_with_heavy_ties_and_nulls(spark):
    rng = np.random.default_rng(3)
    v = np.where(rng.random(4000) < 0.35, 0.0, rng.normal(0, 1e3, 4000))
    v[rng.random(4000) < 0.05] = np.nan
    p = pd.DataFrame({"g": np.where(rng.random(4000) < 0.4, 1, rng.integers(2, 9, 4000)), "v": v})
    s = spark.createDataFrame(p).withColumn("v", F.nanvl("v", F.lit(None).cast("double"))).withColumn("id", F.monotonically_increasing_id())
    got = scaling.with_rank(s, ["g"], "v").select("id", scaling.pct_rank().alias("p")).orderBy("id").toPandas()["p"]
    np.testing.assert_allclose(got, p.groupby("g").v.rank(pct=True), rtol=1e-12)


def test_quantiles_interpolate(spark):
    rng = np.random.default_rng(4)
    p = pd.DataFrame({"g": rng.integers(0, 4, 3000), "v": np.round(rng.normal(0, 1, 3000), 1)})
    got = scaling.quantiles(spark.createDataFrame(p), ["g"], "v", {"a": 0.05, "b": 0.5, "c": 0.93}).orderBy("g").toPandas()
    exp = p.groupby("g").v.quantile([0.05, 0.5, 0.93]).unstack()
    np.testing.assert_allclose(got[["a", "b", "c"]], exp, atol=1e-12)


def queue_lots(t):
    out, q = [], {}
    for r in t.itertuples():
        book = q.setdefault(r.symbol, [])
        if r.action == "buy":
            book.append([r.seq, r.qty])
            continue
        left = r.qty
        while left and book:
            take = min(left, book[0][1])
            out.append((r.symbol, book[0][0], r.seq, take))
            left -= take
            book[0][1] -= take
            if not book[0][1]:
                book.pop(0)
    return sorted(out)


def test_fifo_equals_a_queue_with_oversells_and_a_hot_symbol(spark):
    rng = np.random.default_rng(9)
    n = 600
    t = pd.DataFrame({"symbol": np.where(rng.random(n) < 0.5, 1, rng.integers(2, 6, n)), "seq": rng.permutation(n) * 5000, "qty": rng.integers(1, 400, n)})
    t["trade_date"] = pd.to_datetime("2020-01-01").date()
    t.loc[t.seq % 3 == 0, "trade_date"] = pd.to_datetime("2020-01-02").date()
    t["action"] = np.where(rng.random(n) < 0.5, "buy", "sell")
    t["price"], t["value"], t["cost"] = 1.0, t.qty * 1.0, 0.0
    t = t.sort_values(["trade_date", "seq"])
    got = trades.lots(spark.createDataFrame(t)).select("symbol", "buy_seq", "sell_seq", "matched").collect()
    assert sorted(map(tuple, got)) == queue_lots(t)


def test_brinson_closes(spark):
    p = pd.DataFrame({"industry": list("abc"), "w": [0.5, 0.3, 0.2], "b": [0.4, 0.4, 0.2], "rp": [0.03, 0.01, -0.02], "rb": [0.02, 0.02, -0.01]})
    g = risk.brinson(spark.createDataFrame(p)).toPandas()
    assert g.closed.all()
    total = (g.allocation + g.selection + g.interaction).sum()
    assert total == pytest.approx((p.w * p.rp).sum() - (p.b * p.rb).sum())


def test_rotation_gives_uncorrelated_factors(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=500)
    p = pd.DataFrame({"a": a, "b": a * 0.6 + rng.normal(size=500), "c": rng.normal(size=500) - a * 0.3})
    z = research.orthogonalise(spark.createDataFrame(p), ["a", "b", "c"]).toPandas()[["a_orth", "b_orth", "c_orth"]]
    np.testing.assert_allclose(np.corrcoef(z.T), np.eye(3), atol=1e-6)


def test_pruning_drops_the_weaker_of_a_pair(spark):
    pairs = spark.createDataFrame([("a", "b", 0.95), ("b", "c", 0.9), ("a", "c", 0.1)], "f string, g string, corr double")
    ic = spark.createDataFrame([("a", 0.5), ("b", 0.1), ("c", 0.05)], "factor string, ic double")
    assert [r.factor for r in research.prune_correlated(pairs, ic).collect()] == ["b"]


def test_stream_sink_is_idempotent(spark, tmp_path):
    from barloom.streaming.bars import upsert_sink

    p = panel(2, 5)[["symbol", "trade_date", "close"]]
    path = str(tmp_path / "bars")
    sink = upsert_sink(path)
    first = spark.createDataFrame(p)
    sink(first, 0)
    late = first.where("symbol = 1").withColumn("close", F.col("close") + 1)
    sink(late, 1)
    sink(late, 1)
    got = spark.read.parquet(path).orderBy("symbol", "trade_date").toPandas()
    assert len(got) == 10
    exp = p.assign(close=p.close + (p.symbol == 1))
    np.testing.assert_allclose(got.sort_values(["symbol", "trade_date"]).close, exp.close)


def test_stream_sink_leaves_an_unreadable_table_alone(spark, tmp_path):
    from barloom.streaming.bars import upsert_sink

    path = tmp_path / "bars" / "trade_date=2020-01-01"
    path.mkdir(parents=True)
    (path / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        upsert_sink(str(tmp_path / "bars"))(spark.createDataFrame(panel(1, 3)[["symbol", "trade_date", "close"]]), 0)
    assert [p.name for p in (tmp_path / "bars").rglob("*.parquet")] == ["part-0.parquet"]


def test_last_version_wins_whatever_its_value(spark):
    from barloom.sources.bars import upsert

    stored = spark.createDataFrame([(1, 5.0), (2, 7.0)], "k int, x double")
    feed = spark.createDataFrame([(1, 9.0, 1), (1, 3.0, 2), (3, 1.0, 1)], "k int, x double, v int")
    got = upsert(stored, feed, ["k"], F.col("v"))
    assert sorted(map(tuple, got.select("k", "x").collect())) == [(1, 3.0), (2, 7.0), (3, 1.0)]


@pytest.mark.parametrize("span", [2, 20, 60, 250])
def test_exponential_mean_of_any_span(spark, span):
    p = panel(1, 1500, seed=3)
    got = trend.ema(spark.createDataFrame(p), "e", "close", span).orderBy("trade_date").toPandas().e
    np.testing.assert_allclose(got, p.close.ewm(span=span, adjust=False).mean(), rtol=1e-10)


def test_wilder_of_any_length(spark):
    p = panel(1, 1300, seed=4)
    got = trend.wilder(spark.createDataFrame(p), "e", "close", 30, 29).orderBy("trade_date").toPandas().e
    y = p.close[:30].mean()
    for i in range(30, 1300):
        y += (p.close[i] - y) / 30
    assert got.iloc[-1] == pytest.approx(y)


def test_ranks_leave_out_nan_and_split_small_values(spark):
    from barloom.operators.scaling import avg_rank, value_bin, with_rank

    x = [1e-12, 2e-12, float("nan"), None, -3e-11, 0.0, 1e300, 5e-324, 1e-12]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double")
    got = {r.i: r.k for r in with_rank(df, [], "x").select("i", avg_rank().alias("k")).collect()}
    exp = pd.Series(x, dtype=float).rank()
    assert all(got[i] is None if np.isnan(exp[i]) else got[i] == exp[i] for i in range(len(x)))
    bins = df.where("x is not null and not isnan(x)").orderBy("x").select(value_bin(df, "x")).toPandas().iloc[:, 0]
    assert bins.is_monotonic_increasing and bins.nunique() == 6


def test_shuffle_test_ignores_partitions(spark):
    from barloom.operators import learning

    rng = np.random.default_rng(5)
    p = panel(4, 60)[["symbol", "trade_date"]].assign(pred=rng.normal(size=240))
    p["target"] = p.pred * 0.2 + rng.normal(size=240)
    df = spark.createDataFrame(p)
    one, other = (learning.shuffle_test(d, "target").collect()[0] for d in (df.coalesce(1), df.repartition(7)))
    assert one.p_value == other.p_value and one.ic == pytest.approx(other.ic) == pytest.approx(p.pred.rank().corr(p.target.rank())) and one.p_value < 0.2


@pytest.mark.parametrize("method", ["sample", "ewma", "shrink"])
def test_covariance_from_the_formula(spark, method):
    from barloom.operators import risk

    x = np.random.default_rng(6).normal(size=(50, 3)) @ np.array([[1, 0.6, 0], [0, 1, 0.3], [0, 0, 1]])
    days = pd.bdate_range("2020-01-01", periods=50).date
    long = [(days[t], f"f{k}", float(x[t, k])) for t in range(50) for k in range(3)]
    got = risk.covariance(spark.createDataFrame(long, "trade_date date, factor string, ret double"), method).toPandas().pivot(index="f", columns="g", values="cov").to_numpy()
    s = np.cov(x, rowvar=False)
    if method == "ewma":
        w = 0.94 ** np.arange(49, -1, -1)
        c = x - np.average(x, axis=0, weights=w)
        s = (c * w[:, None]).T @ c / w.sum()
    if method == "shrink":
        c = x - x.mean(0)
        spread = sum(np.mean((c[:, i] * c[:, j] - s[i, j]) ** 2) for i in range(3) for j in range(3))
        off = s - np.diag(np.diag(s))
        s = s - min(1.0, spread / (off**2).sum()) * off
    np.testing.assert_allclose(got, s, rtol=1e-9)


def test_confidence_levels_keep_their_names(spark):
    from barloom.operators import risk

    df = spark.createDataFrame([(float(x),) for x in np.random.default_rng(0).normal(size=500)], "ret double")
    got = risk.var_es(df, levels=(0.97, 0.975))
    assert {"var_97", "var_97_5", "es_97", "es_97_5"} <= set(got.columns)
    row = got.collect()[0]
    assert row.var_97_5 > row.var_97


def test_normal_distribution_function(spark):
    from statistics import NormalDist

    from barloom.operators import risk

    xs = [-40.0, -8.0, -3.3, -1.0, -1e-9, 0.0, 0.5, 2.0, 7.2, 40.0]
    for x, p in spark.createDataFrame([(x,) for x in xs], "x double").select("x", risk.normal_cdf("x")).collect():
        assert p == pytest.approx(NormalDist().cdf(x), rel=1e-6, abs=1e-12)


def test_as_of_each_with_a_hot_key(spark):
    from datetime import date, timedelta

    from barloom.operators import joins

    rng, day = np.random.default_rng(7), lambda n: date(2020, 1, 1) + timedelta(days=int(n))
    facts = [(int(k), day(r), day(r + d) if d < 40 else None, float(i)) for i, (k, r, d) in enumerate(zip(rng.integers(0, 4, 60), rng.integers(0, 900, 60), rng.integers(0, 50, 60)))]
    probes = [(i, 0 if i % 3 else int(rng.integers(0, 5)), day(rng.integers(0, 1000))) for i in range(600)]
    f = spark.createDataFrame(facts, "symbol int, record_date date, disclosure_date date, v double")
    got = {r.i: r.v for r in joins.as_of_each(spark.createDataFrame(probes, "i int, symbol int, at date"), f, "at", ["v"]).collect()}
    for i, k, at in probes:
        known = [(rec, v) for s, rec, dis, v in facts if s == k and (dis or rec) <= at]
        assert got[i] == (max(known)[1] if known else None)
