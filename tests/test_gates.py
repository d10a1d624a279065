"""Gated score against a bar-by-bar walk; costs, vetoes, windows and recommendations on small rows."""

import datetime as dt

import pytest
from conftest import panel
from pyspark.sql import functions as F

from barloom.functions import costs as C
from barloom.operators import patterns as P, rules as U, signals as S, trend


@pytest.fixture(scope="module")
def ready(spark):
    """A rule panel in which the flags of many rules are dealt at random, with a daily score."""
    s = trend.vol_regime(trend.kdj(S.signals(trend.indicators(spark.createDataFrame(panel(4, 160, seed=7))))))
    rnd = lambda k: F.rand(k)
    s = s.withColumns(
        {
            "winner": 100 * rnd(1), "cost5": F.col("close") * (0.85 + 0.1 * rnd(2)), "cost50": F.col("close") * (0.95 + 0.1 * rnd(3)), "cost95": F.col("close") * (1 + 0.1 * rnd(4)),
            "net": rnd(5) - 0.5, "macro": F.lit("boom"), "week_bull": rnd(6) > 0.3, "has_forecast": rnd(8) > 0.8, "daily_score": F.floor(100 * rnd(9)).cast("int"),
        }
    )
    df = U.rule_panel(s).withColumn("amt5", F.col("amt20") * (0.2 + rnd(10)))
    return df.checkpoint()


def walk(row, flags):
    """The gates of one row, in plain Python: flags say which conditions that do not read the score hold."""
    state = {"score": 0.0, "risk": "NONE", "level": "C", "ids": []}

    def run(gate):
        for r in sorted((r for r in U.RULES if r.gate == gate), key=lambda r: (r.priority, r.id)):
            hit = flags[r.id]
            if r.id in ("R11", "R12"):
                hit = hit and state["score"] >= 40
            if r.id == "R21":
                hit = hit and state["score"] >= 60 and state["risk"] != "HIGH"
            if r.id == "R39":
                hit = hit and state["risk"] != "HIGH"
            if not hit:
                continue
            state["ids"].append(r.id)
            change = -row["momentum_score"] / 2 if r.special == "half_momentum" else r.score
            if r.score or r.special:
                state["score"] = min(100.0, max(0.0, state["score"] + change))
            if r.risk == "HIGH" or (r.risk == "MEDIUM" and state["risk"] == "NONE"):
                state["risk"] = r.risk
            if r.level == "D":
                state["level"] = "D"

    run(1)
    run(2)
    if state["risk"] == "HIGH":
        return state["score"], "HIGH", state["level"], True, state["ids"]
    w, reg = row["winner"], row["regime"]
    if w > 80 and reg in ("WEAK_TREND", "TOP_RISK", "UNCLEAR") and state["risk"] in ("NONE", "LOW"):
        state["risk"] = "MEDIUM"
    if row["close"] >= row["cost95"] * 0.95 and w > 70 and state["risk"] in ("NONE", "LOW"):
        state["risk"] = "MEDIUM"
    if (row["cost95"] - row["cost5"]) / max(row["cost5"], 0.01) < 0.15 and row["close"] > row["cost50"] and w > 70:
        state["risk"] = "HIGH" if reg in ("WEAK_TREND", "TOP_RISK") else "MEDIUM"
    run(3)
    score = row["daily_score"]
    level = "D" if state["risk"] == "HIGH" or row["div_type"] == "top" else "A" if score >= 80 else "B" if score >= 60 else "C"
    return score, state["risk"], level, False, state["ids"]


def test_gated_score_equals_a_walk(ready):
    free = {r.id: r.when for r in U.RULES}
    free["R11"], free["R12"], free["R21"], free["R39"] = U.BEAR_LADDER, "coalesce(adx, 0) < 25", U.BULL_LADDER, "aligned >= 4"
    flags = ready.select("symbol", "trade_date", *[F.coalesce(F.expr(w), F.lit(False)).alias(f"f_{i}") for i, w in free.items() if i not in ("R34", "R35", "R30", "R31", "R32", "R33")])
    got = U.gated_score(ready).join(flags, ["symbol", "trade_date"]).toPandas()
    assert got.stopped.any() and not got.stopped.all() and set(got.gated_risk) == {"NONE", "MEDIUM", "HIGH"}
    for row in got.to_dict("records"):
        score, risk, level, stopped, ids = walk(row, {i: row.get(f"f_{i}", False) for i in free})
        mine = [i for i in row["triggered"].split(",") if i and i < "R51"]
        assert (row["gated_score"], row["gated_risk"], row["gated_level"], row["stopped"], mine) == (score, risk, level, stopped, ids)
        if stopped:
            assert row["position_adjust"] == 0.0


def test_commission_tiers_and_limit_orders(spark):
    rows = [(float(v), o) for v in (5_000, 10_000, 45_000, 90_000) for o in ("market", "limit", None)]
    t = spark.createDataFrame(rows, "value double, order_type string").selectExpr(
        "*", "100L AS qty", "1e6D AS adv", "5e8D AS amount_ma20", "0.01D AS amplitude", "DATE'2024-01-02' AS trade_date", "'buy' AS action", "true AS main_market"
    )
    tiers = ((30_000, 0.0002), (10_000, 0.00025))  # in any order
    for r in C.with_costs(t, commission_tiers=tiers, min_commission=0.0).collect():
        rate = 0.0002 if r.value >= 30_000 else 0.00025 if r.value >= 10_000 else 0.0003
        assert r.commission == pytest.approx(r.value * rate)
        assert r.slippage == pytest.approx(r.value * (0.0005 if r.order_type == "limit" else 0.001))


def test_special_treatment_is_vetoed(bars, spark):
    names = spark.createDataFrame([(0, "ST Alpha"), (1, "*Beta"), (2, None)], "symbol long, name string")
    df = P.bull_score(trend.sma(trend.with_index(bars)).join(names, "symbol"), name="name")
    veto = {(r.symbol, r.veto) for r in df.where("veto not in ('thin_volume', 'broken_skeleton')").select("symbol", "veto").distinct().collect()}
    assert veto == {(0, "special_treatment"), (1, "special_treatment"), (2, "")}
    assert df.where("veto = 'special_treatment' and bull_score <> 0").count() == 0


@pytest.mark.parametrize("sign, name", [(1, "morning_doji_star"), (-1, "evening_doji_star")])
def test_doji_stars(spark, sign, name):
    flat = [(100.0, 101.0, 99.0, 100.5)] * 10
    star = [(100.0, 100.5, 95.5, 96.0), (95.0, 95.6, 94.4, 95.01), (95.5, 99.6, 95.4, 99.5)]
    turn = lambda o, h, lo, c: (o, h, lo, c) if sign > 0 else (200 - o, 200 - lo, 200 - h, 200 - c)
    rows = [(1, dt.date(2024, 1, 1) + dt.timedelta(i), *turn(*x)) for i, x in enumerate(flat + star)]
    df = trend.with_index(spark.createDataFrame(rows, "symbol long, trade_date date, open double, high double, low double, close double"))
    got = [r[0] for r in P.named_patterns(df).orderBy("trade_date").select(f"pat_{name}").collect()]
    assert got == [0] * 12 + [sign]


def test_window_and_recommendation(spark):
    t = spark.createDataFrame([(100, True, True, 0, 4), (50, False, False, 1, 30), (70, False, True, 3, 0)], "vs int, amp boolean, shr boolean, sells int, age int")
    c = F.col
    got = t.withColumns(U.opportunity(F.lit(True), c("vs"), c("amp"), c("shr"), c("sells"), c("age"))).collect()
    assert [(r.valid_days, r.remaining_days, r.urgency) for r in got] == [(35, 31, "low"), (23, 0, "expired"), (24, 24, "low")]
    q = spark.createDataFrame(
        [(b, up, n, v) for b in (True, False) for up in (True, False) for n in (0, 1, 2) for v in (20, 40, 60, 80)], "b boolean, up boolean, n int, v int"
    ).withColumn("got", U.recommendation(c("b"), c("up"), c("n"), c("v")))
    for r in q.collect():
        base = {0: ("strong_buy" if r.up else "buy") if r.b else "potential_buy", 1: "cautious_buy" if r.b else "wait"}.get(r.n, "wait")
        if base != "wait" and r.v < 50:
            base = "low_volume_wait" if r.v < 30 else "low_volume_caution"
        elif base in ("strong_buy", "buy") and r.v < 70:
            base = "fair_volume_buy"
        assert r.got == base


def test_recent_days_keeps_late_patterns(bars):
    df = trend.kdj(trend.macd(trend.sma(bars, (60,), min_periods=1)))
    every = U.double_bottom_signals(df)
    late = {tuple(r) for r in U.double_bottom_signals(df, recent_days=40).select("symbol", "valley1").collect()}
    assert late == {(r.symbol, r.valley1) for r in every.collect() if (r.as_of - r.valley2).days <= 40}
