"""Leakage and integrity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import integrity as I, learning as L, risk as K, trades as T
from barloom.plans.registry import R, cte, lead, query, r, rounded, sql
from barloom.plans.limits import costed
from barloom.plans.risk import curves
from barloom.plans.trades import log


@query("w42_labels", sql("adj", f"SELECT symbol, trade_date, {R(lead('close', 5) + '/' + lead('close') + '-1')} AS y_close, {R(lead('close', 5) + '/' + lead('open') + '-1')} AS y_open FROM adj"))
def _(v):
    return v.adj.select("symbol", "trade_date", r(I.label(5)).alias("y_close"), r(I.label(5, "open")).alias("y_open"))


cte("lab", f"SELECT *, CASE WHEN volume>49 THEN 0.5e0 ELSE {lead('close', 5)}/{lead('close')}-1 END AS y, {lead('close', 5)}/{lead('close')}-1 AS t FROM adj", "adj")


@query("i01_label_rebuild", sql("lab", "SELECT count(y) AS n_checked, count(*) FILTER (abs(y-t)>1e-8) AS n_wrong, count(*) FILTER (y IS NOT NULL AND t IS NULL) AS n_beyond_range, count(*) FILTER (abs(y-t)>1e-8 OR (y IS NOT NULL AND t IS NULL))=0 AS passed FROM lab"))
def _(v):
    return I.check_labels(v.adj.withColumn("y", F.when(F.col("volume") > 49, 0.5).otherwise(I.label(5))), "y", 5)


_FUT = {"ret_1": f"{lead('close')}/close-1", "ret_5": f"{lead('close', 5)}/close-1", **{f"next_{c}": lead(c) for c in ("open", "high", "low", "close")}}
cte("leak0", f"SELECT *, {lead('close')} AS leaky, volume*1e0 AS honest FROM adj", "adj")
cte("leak", "SELECT *, " + ", ".join(f"{x} AS f_{k}" for k, x in _FUT.items()) + ", " + ", ".join(f"{lead(f, k)} AS s_{f}_{k}" for f in ("leaky", "honest") for k in (1, 2, 3)) + " FROM leak0", "leak0")
_same = lambda a, b: f"coalesce(count(*) FILTER (abs({a}-{b})<=1e-9)/nullif(count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL),0),0)"


def _leak_sql(f):
    a = "greatest(" + ",".join(_same(f, f"f_{k}") for k in _FUT) + ")"
    b = "greatest(" + ",".join(_same(f, f"s_{f}_{k}") for k in (1, 2, 3)) + ")"
    return f"SELECT '{f}' AS feature, {R(a)} AS future_ratio, {R(b)} AS shift_ratio, ({a})<=0.01 AND ({b})<=0.01 AS passed FROM leak"


@query("i02_feature_leakage", sql("leak", " UNION ALL ".join(_leak_sql(f) for f in ("leaky", "honest"))))
def _(v):
    from barloom.operators.panel import by_symbol

    p = v.adj.withColumn("leaky", F.lead("close").over(by_symbol())).withColumn("honest", F.col("volume").cast("double"))
    return rounded(I.check_feature_leakage(p, ["leaky", "honest"]), "future_ratio", "shift_ratio")


cte("di", "SELECT trade_date, row_number() OVER (ORDER BY trade_date)-1 AS pos FROM (SELECT DISTINCT trade_date FROM adj)", "adj")
cte(
    "fd",
    """SELECT fold, CASE WHEN rel<235 THEN 'train' ELSE 'test' END AS role, trade_date, pos FROM (SELECT f.fold, d.trade_date, d.pos, d.pos-f.fold*65 AS rel FROM di d
    JOIN (SELECT unnest(range(0,1000)) AS fold) f ON f.fold*65+240+65<=(SELECT count(*) FROM di)) WHERE (rel>=0 AND rel<235) OR (rel>=245 AND rel<305)""",
    "di",
)
cte("fb", "SELECT fold, min(pos) FILTER (role='train') AS train_start, max(pos) FILTER (role='train') AS train_end, min(pos) FILTER (role='test') AS test_start, max(pos) FILTER (role='test') AS test_end FROM fd GROUP BY 1", "fd")


def folds(v, bars=None):
    return I.fold_dates(v.adj, 240, 60, purge=5, embargo=5)


@query("m02_walk_forward_folds", sql("fd", "SELECT fold, role, trade_date, pos FROM fd"))
def _(v):
    return folds(v)


@query("i05_fold_check", sql("fb", "SELECT *, test_start-train_end-1 AS gap, test_start-train_end-1>=10 AND coalesce(train_end>lag(train_end) OVER (ORDER BY fold) AND test_end>lag(test_end) OVER (ORDER BY fold),true) AS passed FROM fb"))
def _(v):
    return I.check_folds(I.fold_bounds(folds(v)), 5, 5)


@query("i06_purge_embargo_bands", sql("fb", "SELECT fold, test_start-train_end-1 AS band, test_start-train_end-1>=20 AS purge_ok, test_start-train_end-1>=5 AS embargo_ok FROM fb"))
def _(v):
    return I.check_bands(I.fold_bounds(folds(v)), 20, 5)


def _split_sql(purge):
    return sql(
        "di",
        f""", t AS (SELECT max(pos) AS train_end FROM di WHERE trade_date<DATE '1999-01-01'), w AS (SELECT min(pos) AS val_start FROM di WHERE trade_date>=DATE '1998-12-01'),
        s AS (SELECT count(*) AS n_shared FROM di WHERE trade_date>=DATE '1998-12-01' AND trade_date<DATE '1999-01-01')
        SELECT train_end, val_start, n_shared, val_start-train_end-1 AS gap, greatest(train_end+5-val_start+1,0) AS label_overlap, n_shared=0 AND train_end<val_start AND val_start-train_end-1>={purge} AS passed FROM t, w, s""",
    )


@query("i04_split_check", _split_sql(5))
def _(v):
    return I.check_split(v.adj.where("trade_date < '1999-01-01'"), v.adj.where("trade_date >= '1998-12-01'"), v.adj, 5, 5)


@query(
    "i03_label_interval_overlap",
    sql("di", """SELECT a.train_end, b.val_start, greatest(a.train_end+5-b.val_start+1,0) AS label_overlap FROM (SELECT max(pos) AS train_end FROM di WHERE trade_date<DATE '1999-01-01') a,
        (SELECT min(pos) AS val_start FROM di WHERE trade_date>=DATE '1999-01-01') b"""),
)
def _(v):
    df = I.check_split(v.adj.where("trade_date < '1999-01-01'"), v.adj.where("trade_date >= '1999-01-01'"), v.adj, 5, 5)
    return df.select("train_end", "val_start", "label_overlap")


@query("u04_date_overlap", sql("di", "SELECT trade_date FROM di WHERE trade_date<DATE '1999-01-01' INTERSECT SELECT trade_date FROM di WHERE trade_date>=DATE '1998-12-01'"))
def _(v):
    return v.adj.where("trade_date < '1999-01-01'").select("trade_date").intersect(v.adj.where("trade_date >= '1998-12-01'").select("trade_date"))


@query(
    "i07_anchor_check",
    sql("di", """SELECT (SELECT max(trade_date) FROM di WHERE trade_date<DATE '1999-01-01') AS train_end, (SELECT min(trade_date) FROM di WHERE trade_date>=DATE '1999-02-01') AS first_signal, true AS train_ok,
        (SELECT max(pos) FROM di WHERE trade_date<DATE '1999-01-01')+5<=(SELECT max(pos) FROM di WHERE trade_date<=DATE '1999-01-03') AS label_ok, true AS signal_ok"""),
)
def _(v):
    t = v.adj.where("trade_date < '1999-01-01'")
    return I.check_anchor(t, t, v.adj.where("trade_date >= '1999-02-01'"), v.adj, "1999-01-03", 5)


AUDIT = L.FEATURES


def closed(panel):
    return L.close_features(L.raw_features(panel), AUDIT)


def _ok(cond=""):
    return sql("adj", " UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) AS n_rows, 0::BIGINT AS n_changed, true AS passed FROM adj {cond}" for f in AUDIT))


@query("i08_feature_window_closure", _ok())
def _(v):
    return I.check_feature_window(closed, v.histories, AUDIT)


@query("i08_feature_window_leak")
def _(v):
    return I.check_feature_window(L.raw_features, v.histories, AUDIT)


@query("i09_no_global_statistics", _ok())
def _(v):
    return I.check_no_global_statistics(closed, v.histories, AUDIT)


@query("i10_train_features_invariant", _ok("WHERE trade_date<DATE '2000-01-01'"))
def _(v):
    return I.check_train_invariant(closed, v.histories, AUDIT, "2000-01-01")


@query("i11_execution_price", sql("trades raw", "SELECT action, count(close) AS n_checked, count(*) FILTER (close IS NULL) AS n_without_bar, count(*) FILTER (NOT (price BETWEEN low-1e-6 AND high+1e-6)) AS n_violations FROM trades LEFT JOIN raw USING (symbol, trade_date) GROUP BY 1"))
def _(v):
    return I.check_execution(v.trades, v.raw)


@query("i11_execution_at_close", sql("trades raw", "SELECT action, count(close) AS n_checked, count(*) FILTER (close IS NULL) AS n_without_bar, count(*) FILTER (NOT abs(price-close)<=1e-6) AS n_violations FROM trades LEFT JOIN raw USING (symbol, trade_date) GROUP BY 1"))
def _(v):
    return I.check_execution(v.trades, v.raw, "close")


@query("i12_same_day_contribution", sql("trades raw", f"SELECT action, count(*) AS n, count(*) FILTER (abs(g)>1e-6) AS n_nonzero, {R('sum(g)', 1)} AS same_day_pnl FROM (SELECT action, CASE WHEN action='buy' THEN close-price ELSE price-close END*qty AS g FROM trades JOIN raw USING (symbol, trade_date)) GROUP BY 1"))
def _(v):
    df = I.check_same_day(v.trades, v.raw)
    return df.select("action", "n", "n_nonzero", r("same_day_pnl", 1).alias("same_day_pnl"))


@query("i13_cost_completeness", sql("cst", """SELECT count(*) AS n, count(*) FILTER (action<>'buy' AND (stamp<=0 OR commission<=0)) AS incomplete_sells, count(*) FILTER (slippage<value*0.0005*(1-1e-9)) AS thin_slippage,
    count(*) FILTER (impact>value*0.10*(1+1e-9)) AS impact_over_cap, 0::BIGINT AS bad_totals FROM cst"""))
def _(v):
    return I.check_costs(costed(v))


@query("i14_significance", sql(
    "tl2 lotp ret",
    f""", cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS p FROM (SELECT DISTINCT trade_date FROM trades)),
    s AS (SELECT l.symbol, sell_seq, sum((z.p-a.p)*matched) AS dw, sum(matched) AS w, sum(pnl) AS pnl FROM lotp l JOIN cal a ON a.trade_date=buy_trade_date JOIN cal z ON z.trade_date=sell_trade_date GROUP BY 1,2),
    m AS (SELECT trade_date, avg(ret) AS ret FROM ret GROUP BY 1), g AS (SELECT *, sum(CASE WHEN ret>0 THEN 0 ELSE 1 END) OVER (ORDER BY trade_date) AS id FROM m), u AS (SELECT id, count(*) FILTER (ret>0) AS run FROM g GROUP BY 1),
    x AS (SELECT (SELECT count(*) FROM tl2 WHERE action<>'buy' AND pos=0) AS rounds, (SELECT sum(dw)/sum(w) FROM s) AS hd, (SELECT avg(CASE WHEN pnl>0 THEN 1e0 ELSE 0e0 END) FROM s) AS wr,
    (SELECT count(*) FROM m WHERE ret>0) AS ud, (SELECT count(*) FROM m WHERE ret<0) AS dd, (SELECT max(run) FROM u) AS lr, (SELECT (max(trade_date)-min(trade_date))/365.25e0 FROM m) AS sy)
    SELECT rounds, rounds>=100 AS enough_trades, hd>=2 OR wr>=0.55 AS healthy_holding, sy>=3 AND ud>=60 AND dd>=30 AND lr<=120 AS cycle_covered FROM x""",
))
def _(v):
    df = I.significance(T.rounds(log(v)), T.holding(T.lots(log(v)), v.trades), K.market_cycle(v.adj))
    return df.select("rounds", "enough_trades", "healthy_holding", "cycle_covered")


def _met(cond):
    return f"""SELECT strategy, (avg(r)*252-0.03e0)/(stddev_samp(r)*sqrt(252)) AS s, least((avg(r)*252-0.03e0)/(stddev_samp(r) FILTER (r<0)*sqrt(252)),100) AS t FROM (
        SELECT strategy, value/lag(value) OVER (PARTITION BY strategy ORDER BY trade_date)-1 AS r FROM eq WHERE {cond}) GROUP BY 1"""


cte("ood", f"SELECT a.strategy, CASE WHEN a.s>0 THEN (a.s-b.s)/a.s ELSE 0 END AS sd, CASE WHEN a.t>0 THEN (a.t-b.t)/a.t ELSE 0 END AS td FROM ({_met('trade_date<DATE ' + chr(39) + '1999-01-01' + chr(39))}) a JOIN ({_met('trade_date>=DATE ' + chr(39) + '1999-01-01' + chr(39))}) b USING (strategy)", "eq")


@query("i15_oos_decay", sql("ood", f"SELECT strategy, {R('sd', 5)} AS sharpe_decay, {R('td', 5)} AS sortino_decay, sd<=0.3 AND td<=0.3 AS passed FROM ood"))
def _(v):
    c = curves(v)
    df = I.oos_decay(K.equity_metrics(c.where("trade_date < '1999-01-01'")), K.equity_metrics(c.where("trade_date >= '1999-01-01'")))
    return rounded(df, "sharpe_decay", "sortino_decay", d=5)
