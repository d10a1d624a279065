"""Risk, attribution and performance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import risk as K
from barloom.operators.panel import by_symbol
from barloom.operators.scaling import reuse
from barloom.plans.registry import R, Rs, cte, lag, query, r, rounded, sql

# A book: supplier balances as weights; the market: the equal-weighted mean return.
cte("ret", f"SELECT symbol, trade_date, close/{lag('close')}-1 AS ret FROM adj", "adj")
cte("bw", "SELECT symbol, acctbal/sum(acctbal) OVER () AS weight, l1 AS industry FROM industry WHERE acctbal>0", "industry")
cte("pr", "SELECT trade_date, sum(weight*ret) AS ret FROM ret JOIN bw USING (symbol) WHERE ret IS NOT NULL GROUP BY 1", "ret", "bw")
cte("br", "SELECT trade_date, avg(ret) AS ret FROM ret GROUP BY 1 HAVING avg(ret) IS NOT NULL", "ret")
cte("ab", "SELECT trade_date, pr.ret AS a, br.ret AS b FROM pr JOIN br USING (trade_date)", "pr", "br")
cte("irt", "SELECT l1 AS strategy, trade_date, avg(ret) AS ret FROM ret JOIN industry USING (symbol) WHERE ret IS NOT NULL GROUP BY 1,2", "ret", "industry")


def book(v):
    b = v.industry.where("acctbal > 0")
    t = b.agg(F.sum("acctbal")).scalar()
    return b.select("symbol", (F.col("acctbal") / t).alias("weight"), F.col("l1").alias("industry"))


def port(v):
    return K.portfolio_returns(book(v).select("symbol", "weight"), v.adj)


def market(v):
    return K.simple_returns(v.adj).groupBy("trade_date").agg(F.avg("ret").alias("ret")).where("ret is not null")


def strategies(v):
    rets = K.simple_returns(v.adj).where("ret is not null").join(v.industry.select("symbol", F.col("l1").alias("strategy")), "symbol")
    return rets.groupBy("strategy", "trade_date").agg(F.avg("ret").alias("ret"))


@query("a11_portfolio_returns", sql("pr", f"SELECT trade_date, {R('ret')} AS ret FROM pr"))
def _(v):
    return rounded(port(v), "ret")


# Test prices are random, so returns are damped to keep compounded figures finite.
cte(
    "bst",
    """SELECT count(*) AS n, exp(sum(ln(1+a)))-1 AS cp, exp(sum(ln(1+b)))-1 AS cb, avg(a) AS ma, avg(b) AS mb, stddev_samp(a) AS sa, covar_samp(a,b)/var_samp(b) AS beta, stddev_samp(a-b) AS sd
    FROM (SELECT a/1e4 AS a, b/1e4 AS b FROM ab)""",
    "ab",
)


@query(
    "a12_benchmark_stats",
    sql(
        "bst",
        f"""SELECT n, {R('cp', 4)} AS cum_portfolio, {R('cb', 4)} AS cum_benchmark, {R('beta')} AS beta, {R('(pow(1+ma,252)-1-0.02e0)-beta*(pow(1+mb,252)-1-0.02e0)', 4)} AS alpha,
        {R('(ma-0.02e0/252)/sa*sqrt(252)')} AS sharpe, {R('sd*sqrt(252)')} AS tracking_error, {R('(ma-mb)/sd')} AS information_ratio, {R('(ma-mb)/sd*sqrt(252)')} AS information_ratio_annual FROM bst""",
    ),
)
def _(v):
    damp = lambda d: d.withColumn("ret", F.col("ret") / 1e4)
    df = rounded(K.benchmark_stats(K.aligned(damp(port(v)), damp(market(v)))), "cum_portfolio", "cum_benchmark", "alpha", d=4)
    return rounded(df, "beta", "sharpe", "tracking_error", "information_ratio", "information_ratio_annual")


# Equity curves per industry: the damped compounded mean return.
cte("eq", "SELECT strategy, trade_date, exp(sum(ln(1+ret/1e4)) OVER (PARTITION BY strategy ORDER BY trade_date)) AS value, abs(ret) AS turnover FROM irt", "irt")
cte("eq1", "SELECT *, value/lag(value) OVER w-1 AS r, value/max(value) OVER w-1 AS dd, row_number() OVER w AS n FROM eq WINDOW w AS (PARTITION BY strategy ORDER BY trade_date ROWS UNBOUNDED PRECEDING)", "eq")
cte("eq2", "SELECT *, quantile_cont(r,0.05) OVER (PARTITION BY strategy) AS q, arg_max(n, (value, -n)) OVER (PARTITION BY strategy) AS pk FROM eq1", "eq1")
cte(
    "eqm",
    """SELECT strategy, arg_max(value,n)/arg_min(value,n)-1 AS tr, count(r) AS c, avg(r)*252-0.03e0 AS mu, stddev_samp(r)*sqrt(252) AS sd, stddev_samp(r) FILTER (r<0)*sqrt(252) AS dn,
    min(dd) AS mdd, max(q) AS q, avg(r) FILTER (r<=q) AS cv, avg(turnover) AS tav, max(turnover) AS mt, (arg_min(n, (value, n)) FILTER (n>=pk))-max(pk) AS dur FROM eq2 GROUP BY 1""",
    "eq2",
)
cte("eqc", "SELECT *, CASE WHEN tr>-1 THEN pow(1+tr,252/c)-1 ELSE tr END AS cagr FROM eqm", "eqm")


def curves(v):
    from pyspark.sql import Window as W

    w = W.partitionBy("strategy").orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
    return strategies(v).select("strategy", "trade_date", F.exp(F.sum(F.log1p(F.col("ret") / 1e4)).over(w)).alias("value"), F.abs("ret").alias("turnover"))


def calmar():
    """The ratio as the SQL divides: infinite for a gain without drawdown, where the operator gives 0."""
    risen = (F.col("max_drawdown") == 0) & (F.col("annual_return") > 0)
    return F.when(risen, float("inf")).otherwise(r("calmar_ratio", 4))


@query(
    "a13_equity_metrics",
    sql(
        "eqc",
        f"""SELECT strategy, {R('tr')} AS total_return, {R('cagr')} AS annual_return, {R('sd')} AS annual_vol, {R('mu/sd', 4)} AS sharpe_ratio, {R('least(mu/dn,100)', 4)} AS sortino_ratio,
        {R('cagr/abs(mdd)', 4)} AS calmar_ratio, {R('mdd')} AS max_drawdown, dur AS max_drawdown_duration, {R('q')} AS var_95, {R('cv')} AS cvar_95, {R('tav')} AS avg_turnover, {R('mt')} AS max_turnover FROM eqc""",
    ),
)
def _(v):
    df = K.equity_metrics(curves(v))
    four = ("sharpe_ratio", "sortino_ratio", "calmar_ratio")
    df = rounded(df, "sharpe_ratio", "sortino_ratio", d=4).withColumn("calmar_ratio", calmar())
    return rounded(df, *[c for c in df.columns if c not in (*four, "strategy", "max_drawdown_duration")])


cte("vr", "SELECT strategy, ret, quantile_cont(ret,0.05) OVER w AS q95, quantile_cont(ret,0.01) OVER w AS q99 FROM irt WINDOW w AS (PARTITION BY strategy)", "irt")


@query(
    "a19_var_es",
    sql(
        "vr",
        f"""SELECT strategy, count(*) AS n, {R('avg(ret)')} AS mean, {R('stddev_samp(ret)*sqrt(252)')} AS annual_vol, {R('-max(q95)*sqrt(5)')} AS var_95, {R('-max(q99)*sqrt(5)')} AS var_99,
        {R('-(avg(ret) FILTER (ret<=q95))*sqrt(5)')} AS es_95, {R('-(avg(ret) FILTER (ret<=q99))*sqrt(5)')} AS es_99 FROM vr GROUP BY 1""",
    ),
)
def _(v):
    return rounded(K.var_es(strategies(v), ["strategy"], horizon=5), "mean", "annual_vol", "var_95", "var_99", "es_95", "es_99")


cte("rv", "SELECT symbol, trade_date, ret, count(*) OVER w AS c, quantile_cont(ret,1-0.95e0) OVER w AS q, list(ret) OVER w AS a, stddev_samp(ret) OVER w AS s FROM ret WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS 59 PRECEDING)", "ret")


@query("w39_rolling_var", sql("rv", f"SELECT symbol, trade_date, CASE WHEN c>=30 THEN {R('-q')} END AS var, CASE WHEN c>=30 THEN {R('-list_avg(list_filter(a, lambda x: x<=q))')} END AS es, CASE WHEN c>=30 THEN {R('s*sqrt(252)')} END AS vol FROM rv"))
def _(v):
    return rounded(K.rolling_var(K.simple_returns(v.adj)), "var", "es", "vol")


# --- Brinson --------------------------------------------------------------------------------

_G = """SELECT {y} i.l1 AS industry, coalesce(sum(b.weight),0) AS w, count(*)*1e0 AS b, coalesce(sum(coalesce(b.weight,0)*f.ret)/nullif(sum(b.weight),0),0) AS rp, avg(f.ret) AS rb
    FROM (SELECT {y} symbol, arg_max(close,trade_date)/arg_min(close,trade_date)-1 AS ret FROM {src} GROUP BY ALL) f JOIN industry i ON f.symbol=i.symbol LEFT JOIN bw b ON b.symbol=f.symbol GROUP BY ALL"""
cte("bg", _G.format(y="", src="adj"), "adj", "industry", "bw")
cte("adjy", "SELECT *, year(trade_date) AS yr FROM adj", "adj")
cte("bgy", _G.format(y="yr,", src="adjy"), "adjy", "industry", "bw")


def _brin(src, by=""):
    p = f"PARTITION BY {by}" if by else ""
    return f"""SELECT *, (w-b)*(rb-trb) AS al, b*(rp-rb) AS se, (w-b)*(rp-rb) AS it, trp-trb AS ex FROM (SELECT *, sum(b*rb) OVER ({p}) AS trb, sum(w*rp) OVER ({p}) AS trp FROM (
        SELECT * REPLACE (w/sum(w) OVER ({p}) AS w, b/sum(b) OVER ({p}) AS b) FROM {src}))"""


cte("bri", _brin("bg"), "bg")
cte("briy", _brin("bgy", "yr"), "bgy")


@query("a20_brinson", sql("bri", f"SELECT industry, {Rs('w b rp rb')}, {R('al')} AS allocation, {R('se')} AS selection, {R('it')} AS interaction, {R('ex')} AS excess, true AS closed FROM bri"))
def _(v):
    g = K.brinson_groups(book(v).select("symbol", "weight"), v.adj, v.industry.select("symbol", F.col("l1").alias("industry")))
    df = K.brinson(g)
    return rounded(df, *[c for c in df.columns if c not in ("industry", "closed")])


@query("a22_attribution_from_holdings", sql("bg", f"SELECT industry, {Rs('w b rp rb')} FROM bg"))
def _(v):
    return rounded(K.brinson_groups(book(v).select("symbol", "weight"), v.adj, v.industry.select("symbol", F.col("l1").alias("industry"))), "w", "b", "rp", "rb")


@query(
    "a21_attribution_periods",
    sql(
        "briy",
        f"""SELECT {R('sum(al)')} AS allocation, {R('sum(se)')} AS selection, {R('sum(it)')} AS interaction, count(DISTINCT yr) AS periods,
        (SELECT {R('exp(sum(ln(1+t)))-1', 4)} FROM (SELECT yr, max(trp) AS t FROM briy GROUP BY 1)) AS portfolio, (SELECT {R('exp(sum(ln(1+t)))-1', 4)} FROM (SELECT yr, max(trb) AS t FROM briy GROUP BY 1)) AS benchmark FROM briy""",
    ),
)
def _(v):
    bars = v.adj.withColumn("yr", F.year("trade_date"))
    g = K.brinson_groups(book(v).select("symbol", "weight"), bars, v.industry.select("symbol", F.col("l1").alias("industry")), ["yr"])
    e = K.brinson(g, ["yr"])
    rets = e.groupBy("yr").agg(F.sum(F.col("w") * F.col("rp")).alias("portfolio"), F.sum(F.col("b") * F.col("rb")).alias("benchmark"))
    df = rounded(K.brinson_periods(e, "yr", rets), "allocation", "selection", "interaction")
    return rounded(df, "portfolio", "benchmark", d=4)


# --- factor risk ----------------------------------------------------------------------------

cte("fx", "SELECT symbol, 'roe' AS factor, roe/5-1 AS value FROM fund UNION ALL SELECT symbol, 'margin', net_profit_margin/25-1 FROM fund UNION ALL SELECT symbol, 'growth', revenue_growth/33-1 FROM fund", "fund")
cte("exps", "SELECT factor, sum(weight*value) AS exposure FROM fx JOIN bw USING (symbol) GROUP BY 1", "fx", "bw")
cte("fcov", "SELECT a.factor AS f, b.factor AS g, covar_samp(a.value,b.value) AS cov FROM fx a JOIN fx b USING (symbol) GROUP BY 1,2", "fx")


def exposures(v):
    f = v.fund.select("symbol", (F.col("roe") / 5 - 1).alias("roe"), (F.col("net_profit_margin") / 25 - 1).alias("margin"), (F.col("revenue_growth") / 33 - 1).alias("growth"))
    return f.unpivot(["symbol"], ["roe", "margin", "growth"], "factor", "value")


def idio(v):
    return K.simple_returns(v.adj).groupBy("symbol").agg(F.stddev_samp("ret").alias("idio_vol"))


cte("idi", "SELECT symbol, stddev_samp(ret) AS idio_vol FROM ret GROUP BY 1", "ret")
cte("frk", "SELECT (SELECT sum(x.exposure*cov*y.exposure) FROM fcov JOIN exps x ON x.factor=f JOIN exps y ON y.factor=g) AS fv, (SELECT sum(pow(weight*idio_vol,2)) FROM bw JOIN idi USING (symbol)) AS iv", "fcov", "exps", "bw", "idi")


@query("a23_factor_risk", sql("frk", f"SELECT {R('fv', 9)} AS factor_var, {R('iv', 6)} AS idio_var, {R('sqrt((fv+iv)*252)')} AS total_vol, {R('fv/(fv+iv)', 9)} AS factor_share, {R('iv/(fv+iv)', 9)} AS idio_share FROM frk"))
def _(v):
    w = book(v).select("symbol", "weight")
    x = exposures(v)
    cov = x.select("symbol", F.col("factor").alias("f"), F.col("value").alias("a")).join(x.select("symbol", F.col("factor").alias("g"), F.col("value").alias("b")), "symbol")
    cov = cov.groupBy("f", "g").agg(F.covar_samp("a", "b").alias("cov"))
    df = K.factor_risk(K.factor_exposure(x, w), cov, w, idio(v))
    return rounded(rounded(df, "factor_var", "factor_share", "idio_share", d=9), "idio_var", "total_vol")


@query("t03_top_risk_contributors", sql("bw idi", f"SELECT symbol, {R('weight')} AS weight, {R('pow(weight*idio_vol,2)', 4)} AS contribution FROM bw JOIN idi USING (symbol) ORDER BY pow(weight*idio_vol,2) DESC, symbol LIMIT 10"))
def _(v):
    df = K.top_contributors(book(v).select("symbol", "weight"), idio(v))
    return df.select("symbol", r("weight").alias("weight"), r("contribution", 4).alias("contribution"))


cte("ols1", "SELECT regr_slope(ab.a, ab.b) AS b1, regr_intercept(ab.a, ab.b) AS b0, regr_r2(ab.a, ab.b) AS r2, count(*) AS n, stddev_pop(ab.b)*sqrt(count(*)) AS sx, sqrt(greatest(var_pop(ab.a)*count(*)*(1-regr_r2(ab.a,ab.b)),0)/(count(*)-2)) AS se, avg(ab.b) AS mb FROM ab", "ab")


@query(
    "a24_ols_exposure",
    sql(
        "ols1",
        f"""SELECT 'const' AS term, {R('b0')} AS beta, {R('b0/(se*sqrt(1e0/n+mb*mb/(sx*sx)))', 4)} AS t_value, {R('r2')} AS r2, {R('1-(1-r2)*(n-1)/(n-2)')} AS adj_r2, n FROM ols1
        UNION ALL SELECT 'ret_b', {R('b1')}, {R('b1/(se/sx)', 4)}, {R('r2')}, {R('1-(1-r2)*(n-1)/(n-2)')}, n FROM ols1""",
    ),
)
def _(v):
    df = K.ols(K.aligned(port(v), market(v)), "ret_a", ["ret_b"])
    return df.select("term", r("beta").alias("beta"), r("t_value", 4).alias("t_value"), r("r2").alias("r2"), r("adj_r2").alias("adj_r2"), "n")


cte("iex", "SELECT industry, sum(weight) AS exposure FROM bw GROUP BY 1", "bw")


@query("a25_industry_exposure", sql("iex", f"SELECT industry, {R('exposure')} AS exposure, {R('(SELECT sum(exposure*exposure) FROM iex)')} AS hhi FROM iex"))
def _(v):
    e = K.industry_exposure(book(v).select("symbol", "weight"), v.industry.select("symbol", F.col("l1").alias("industry")))
    h = K.hhi(e).select("hhi").scalar()
    return rounded(e.withColumn("hhi", h), "exposure", "hhi")


cte("sh", "SELECT strategy, year(trade_date) AS y, avg(ret)/stddev_samp(ret) AS s FROM irt GROUP BY 1,2", "irt")
cte("pw", 'SELECT a.y AS "window", a.strategy AS combo, a.s AS i, b.s AS o FROM sh a JOIN sh b ON a.strategy=b.strategy AND b.y=a.y+1', "sh")


@query("a27_overfitting_probability", sql("pw", f'SELECT {R("avg(CASE WHEN best<med THEN 1e0 ELSE 0e0 END)")} AS pbo, count(*) AS windows FROM (SELECT "window", arg_max(o, i) AS best, median(o) AS med FROM pw GROUP BY 1)'))
def _(v):
    s = strategies(v).groupBy("strategy", F.year("trade_date").alias("y")).agg((F.avg("ret") / F.stddev_samp("ret")).alias("s"))
    nxt = s.select("strategy", (F.col("y") - 1).alias("y"), F.col("s").alias("oos_sharpe"))
    w = s.join(nxt, ["strategy", "y"]).select(F.col("y").alias("window"), F.ascii("strategy").alias("combo"), F.col("s").alias("is_sharpe"), "oos_sharpe")
    return rounded(K.pbo(w), "pbo")


cte("iva", "SELECT strategy, 1/stddev_samp(ret)/sum(1/stddev_samp(ret)) OVER () AS weight FROM irt GROUP BY 1", "irt")


@query("a29_inverse_vol_merge", sql("irt iva", f"SELECT trade_date, {R('sum(weight*ret)')} AS ret FROM irt JOIN iva USING (strategy) GROUP BY 1"))
def _(v):
    c = strategies(v)
    return rounded(K.merge_curves(c, K.inverse_vol_allocation(c)), "ret")


@query(
    "a30_market_cycle",
    sql(
        "ret",
        f""", m AS (SELECT trade_date, avg(ret) AS ret FROM ret GROUP BY 1), g AS (SELECT *, sum(CASE WHEN ret>0 THEN 0 ELSE 1 END) OVER (ORDER BY trade_date) AS id FROM m),
        u AS (SELECT id, count(*) FILTER (ret>0) AS run FROM g GROUP BY 1)
        SELECT (SELECT count(*) FROM m WHERE ret>0) AS up_days, (SELECT count(*) FROM m WHERE ret<0) AS down_days, (SELECT max(run) FROM u) AS longest_up_run,
        (SELECT {R('(max(trade_date)-min(trade_date))/365.25e0')} FROM m) AS span_years""",
    ),
)
def _(v):
    return rounded(K.market_cycle(v.adj), "span_years")


_COVQ = "SELECT strategy AS factor, trade_date, ret FROM irt WHERE trade_date IN (SELECT trade_date FROM irt GROUP BY 1 HAVING count(*)=5)"
cte("cr", f"SELECT *, dense_rank() OVER (ORDER BY trade_date DESC)-1 AS age FROM ({_COVQ})", "irt")
cte("cx", "SELECT *, ret-avg(ret) OVER p AS x, ret-sum(pow(0.94e0,age)*ret) OVER p/sum(pow(0.94e0,age)) OVER p AS y FROM cr WINDOW p AS (PARTITION BY factor)", "cr")


def cov_input(v):
    s = strategies(v).select(F.col("strategy").alias("factor"), "trade_date", "ret")
    every = s.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n")).where("n = 5").select("trade_date")
    return s.join(every, "trade_date")


@query(
    "a32_covariance",
    sql(
        "cx",
        f""", s AS (SELECT a.factor AS f, b.factor AS g, sum(a.x*b.x)/(count(*)-1) AS c, sum(pow(0.94e0,a.age)*a.y*b.y)/sum(pow(0.94e0,a.age)) AS e FROM cx a JOIN cx b USING (trade_date) GROUP BY 1,2),
        v AS (SELECT s.f, s.g, avg(pow(a.x*b.x-s.c,2)) AS v FROM s JOIN cx a ON a.factor=s.f JOIN cx b ON b.factor=s.g AND a.trade_date=b.trade_date GROUP BY 1,2),
        d AS (SELECT least(1, (SELECT sum(v) FROM v)/(SELECT sum(c*c) FROM s WHERE f<>g)) AS d)
        SELECT f, g, {R('c')} AS sample, {R('e')} AS ewma, {R('CASE WHEN f=g THEN c ELSE (1-d)*c END')} AS shrunk FROM s, d""",
    ),
)
def _(v):
    x = reuse(cov_input(v))
    df = K.covariance(x).withColumnRenamed("cov", "sample")
    df = df.join(K.covariance(x, "ewma").withColumnRenamed("cov", "ewma"), ["f", "g"]).join(K.covariance(x, "shrink").withColumnRenamed("cov", "shrunk"), ["f", "g"])
    return rounded(df, "sample", "ewma", "shrunk")


cte("syr", "SELECT symbol, trade_date, ret-avg(ret) OVER (PARTITION BY symbol) AS x FROM (SELECT symbol, trade_date, close/lag(close) OVER (PARTITION BY symbol ORDER BY trade_date)-1 AS ret FROM adj) WHERE ret IS NOT NULL", "adj")


@query("a32_symbol_covariance", sql("syr", f"SELECT a.symbol AS f, b.symbol AS g, CASE WHEN count(*)>1 THEN {R('sum(a.x*b.x)/(count(*)-1)', 8)} END AS cov FROM syr a JOIN syr b USING (trade_date) GROUP BY 1,2"))
def _(v):
    ret = F.try_divide(F.col("close"), F.lag("close").over(by_symbol())) - 1
    return rounded(K.covariance(v.adj.select(F.col("symbol").alias("factor"), "trade_date", ret.alias("ret"))), "cov", d=8)


cte("mom", "SELECT strategy, count(*)*1e0 AS n, avg(ret)/stddev_samp(ret) AS s, skewness(ret) AS sk, kurtosis(ret) AS ku FROM irt GROUP BY 1", "irt")


@query("c31_probabilistic_sharpe", sql("mom", f"SELECT strategy, {R('s')} AS sharpe, {R('sk', 5)} AS skew, {R('ku', 4)} AS kurt, {R('s*sqrt(n-1)/sqrt(1-sk*s+(ku+2)/4*s*s)', 5)} AS psr_z FROM mom"))
def _(v):
    df = K.probabilistic_sharpe(K.moments(strategies(v), ["strategy"]))
    return df.select("strategy", r("sharpe").alias("sharpe"), r("skew", 5).alias("skew"), r("kurt", 4).alias("kurt"), r("psr_z", 5).alias("psr_z"))


_BEST = K.deflated_target(20, 0.01)


@query("c31_deflated_sharpe", sql("mom", f"SELECT strategy, {R('s')} AS sharpe, {R(f'(s-{_BEST!r}e0)*sqrt(n-1)/sqrt(1-sk*s+(ku+2)/4*s*s)', 5)} AS psr_z FROM mom"))
def _(v):
    df = K.probabilistic_sharpe(K.moments(strategies(v), ["strategy"]), _BEST)
    return df.select("strategy", r("sharpe").alias("sharpe"), r("psr_z", 5).alias("psr_z"))


_L = 3
cte("dmx", "SELECT trade_date, a-b-avg(a-b) OVER () AS x, avg(a-b) OVER () AS m FROM ab", "ab")
_GAM = "+".join(f"2*(1-{j}/{_L + 1}e0)*(sum(x*l{j})/(count(*)-{j}))" for j in range(1, _L + 1))


@query(
    "c32_diebold_mariano",
    sql(
        "dmx",
        f""", l AS (SELECT *, {', '.join(f'lag(x,{j}) OVER (ORDER BY trade_date) AS l{j}' for j in range(1, _L + 1))} FROM dmx)
        SELECT count(*) AS n, {R('max(m)')} AS mean, {R(f'sum(x*x)/count(*)+{_GAM}')} AS long_run_var, {R(f'max(m)/sqrt((sum(x*x)/count(*)+{_GAM})/count(*))', 5)} AS dm FROM l""",
    ),
)
def _(v):
    df = K.diebold_mariano(K.aligned(port(v), market(v)), _L)
    return df.select("n", r("mean").alias("mean"), r("long_run_var").alias("long_run_var"), r("dm", 5).alias("dm"))


cte("hs", "SELECT trade_date, (e-mu)/sd-mu/(2*pow(sd,3))*((e-mu)*(e-mu)-sd*sd) AS u, mu, sd FROM (SELECT *, avg(e) OVER () AS mu, stddev_pop(e) OVER () AS sd FROM (SELECT trade_date, ret-0.03e0/252 AS e FROM pr))", "pr")
_GH = "+".join(f"2*(1-{j}/{_L + 1}e0)*(sum(x*l{j})/count(*))" for j in range(1, _L + 1))


@query(
    "c33_hac_sharpe_error",
    sql(
        "hs",
        f""", c AS (SELECT trade_date, mu, sd, u-avg(u) OVER () AS x FROM hs), l AS (SELECT *, {', '.join(f'lag(x,{j}) OVER (ORDER BY trade_date) AS l{j}' for j in range(1, _L + 1))} FROM c)
        SELECT count(*) AS n, {R('max(mu)/max(sd)*sqrt(252)')} AS sharpe, {R(f'sqrt(greatest(sum(x*x)/count(*)+{_GH},0)/count(*))*sqrt(252)')} AS se FROM l""",
    ),
)
def _(v):
    return rounded(K.hac_sharpe_se(port(v), _L), "sharpe", "se")
