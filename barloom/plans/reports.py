"""Report, text and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import dates as D, text as T
from barloom.operators import joins as J, panel, patterns, report as P, trend
from barloom.plans.cross_section import FACTORS, scored, z_factors
from barloom.plans.registry import R, cte, pctrank, query, r, rounded, sql

_UNIT = "CASE o_orderpriority WHEN '1-URGENT' THEN '亿' WHEN '2-HIGH' THEN '万' WHEN '3-MEDIUM' THEN '%' ELSE '' END"


def money_text(v):
    u = F.when(F.col("o_orderpriority") == "1-URGENT", "亿").when(F.col("o_orderpriority") == "2-HIGH", "万").when(F.col("o_orderpriority") == "3-MEDIUM", "%").otherwise("")
    t = F.when(F.col("o_orderstatus") == "P", F.lit("--")).otherwise(F.concat(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), u))
    return v.table("orders").select("o_orderkey", t.alias("t"))


@query("c20_money_text", f"""SELECT o_orderkey, {R("CASE WHEN o_orderstatus='P' THEN 0e0 ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)*CASE o_orderpriority WHEN '1-URGENT' THEN 1e8 WHEN '2-HIGH' THEN 1e4 WHEN '3-MEDIUM' THEN 0.01e0 ELSE 1e0 END END", 2)} AS amount FROM orders""")
def _(v):
    return money_text(v).select("o_orderkey", r(T.money(F.col("t")), 2).alias("amount"))


@query("c25_percent_text", "SELECT o_orderkey, CASE WHEN o_orderstatus='P' OR o_orderpriority IN ('1-URGENT','2-HIGH') THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS pct FROM orders")
def _(v):
    return money_text(v).select("o_orderkey", T.percent(F.col("t")).alias("pct"))


@query("c21_flow_units", "SELECT o_orderkey, CASE WHEN (SELECT max(abs(o_totalprice)) FROM orders)>1e6 THEN o_totalprice/1e4 ELSE o_totalprice END AS a, o_totalprice*1e3/1e4 AS b FROM orders")
def _(v):
    o = v.table("orders").select("o_orderkey", F.col("o_totalprice").alias("a"), (F.col("o_totalprice") * 1e3).alias("b"))
    return T.to_ten_thousands(o, ["a", "b"])


@query("c22_date_text", "SELECT o_orderkey, CASE WHEN o_orderpriority='4-NOT SPECIFIED' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders")
def _(v):
    p = F.col("o_orderpriority")
    t = F.when(p == "1-URGENT", F.date_format("o_orderdate", "yyyyMMdd")).when(p == "2-HIGH", F.date_format("o_orderdate", "yyyy/MM/dd")).when(p == "4-NOT SPECIFIED", "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return v.table("orders").select("o_orderkey", D.parse_date(t).alias("d"))


@query("c23_disclosure_rule", sql("quality", "SELECT DISTINCT record_date, disclosure_date FROM quality"))
def _(v):
    return v.quality.select("record_date", "disclosure_date").distinct()


@query("c24_business_day_gap", sql("raw", """, cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS p FROM (SELECT DISTINCT trade_date FROM raw)), b AS (SELECT symbol, min(trade_date) AS a, max(trade_date) AS z FROM raw GROUP BY 1)
    SELECT symbol, y.p-x.p AS gap FROM b JOIN cal x ON x.trade_date=a JOIN cal y ON y.trade_date=z"""))
def _(v):
    from barloom.operators.integrity import date_index

    idx = date_index(v.raw)
    b = v.raw.groupBy("symbol").agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("z"))
    j = b.join(idx.select(F.col("trade_date").alias("a"), F.col("pos").alias("p")), "a").join(idx.select(F.col("trade_date").alias("z"), F.col("pos").alias("q")), "z")
    return j.select("symbol", (F.col("q") - F.col("p")).alias("gap"))


@query("c26_name_flags", "SELECT p_partkey, contains(upper(replace(p_name,' ','')),'ST') AS is_st, contains(p_name,'退') AS is_delisting FROM part")
def _(v):
    st, dl = J.name_flags(F.col("p_name"))
    return v.table("part").select("p_partkey", st.alias("is_st"), dl.alias("is_delisting"))


@query("c34_factor_json", sql("zf", f"SELECT symbol, {R('momentum')} AS momentum, {R('quality')} AS quality, {R('volatility')} AS volatility FROM zf"))
def _(v):
    z = z_factors(v)
    m = z.select("symbol", P.pack_factors(z, FACTORS).alias("factors")).select("symbol", P.unpack_factors(F.col("factors")).alias("m"))
    return m.select("symbol", *[r(F.col("m")[f]).alias(f) for f in ("momentum", "quality", "volatility")])


@query("c35_signal_token", "SELECT p_partkey, split_part(trim(p_name),' ',1) AS token FROM part")
def _(v):
    return v.table("part").select("p_partkey", T.first_token(F.col("p_name")).alias("token"))


@query("p01_column_aliases", "SELECT p_partkey AS code, p_name AS name FROM part WHERE NOT regexp_matches(p_name, '(?i)st|退')")
def _(v):
    from barloom.sources.bars import not_special

    t = T.resolve(v.table("part"), {"code": ["code", "P_PARTKEY"], "name": ["p_name"], "price": ["absent"]})
    return not_special(t)


@query("p02_special_treatment_filter", "SELECT count(*) AS n FROM part WHERE NOT regexp_matches(p_name, '(?i)st|退')")
def _(v):
    from barloom.sources.bars import not_special

    return not_special(v.table("part"), "p_name").agg(F.count(F.lit(1)).alias("n"))


@query("p03_any_signal", "SELECT p_partkey FROM part WHERE p_size=1 OR p_type='ECONOMY'")
def _(v):
    t = v.table("part").select("p_partkey", F.when(F.col("p_size") == 1, "yes").otherwise("no").alias("strong"), F.when(F.col("p_type") == "ECONOMY", F.col("p_type")).otherwise("  ").alias("sig"))
    return P.any_signal(t, ["strong"], ["sig"]).select("p_partkey")


cte("p4", f"SELECT symbol, {pctrank('score', 'l1')}*100 AS sp, {pctrank('momentum', 'l1')}*100 AS mp, {pctrank('quality', 'l1')}*100 AS qp, {pctrank('valuation', 'l1')}*100 AS vp FROM scored", "scored")


@query("p04_weak_filter", sql("p4 bs3", """SELECT p4.symbol FROM p4 JOIN (SELECT symbol, arg_max(bull_level, trade_date) AS lv, arg_max(veto, trade_date) AS veto FROM bs3 GROUP BY 1) b USING (symbol)
    WHERE veto<>'thin_volume' AND (lv IN ('full_bull','accelerating') OR mp>80 OR qp>80 OR vp>80 OR sp>=10)"""))
def _(v):
    from barloom.operators.cross_section import percent_rank
    from barloom.operators.scaling import reuse

    s = percent_rank(reuse(scored(v)), ["l1"], {"score_pct": "score", "momentum_pct": "momentum", "quality_pct": "quality", "valuation_pct": "valuation"})
    s = s.withColumns({c: F.col(c) * 100 for c in ("score_pct", "momentum_pct", "quality_pct", "valuation_pct")})
    b = panel.last_rows(patterns.bull_score(trend.sma(trend.with_index(v.adj))).select("symbol", "trade_date", "bull_level", "veto"))
    j = s.join(b, "symbol").withColumn("trend_level", F.col("bull_level")).withColumn("conclusion", F.when(F.col("veto") == "thin_volume", "D: thin").otherwise("B: ok"))
    return P.drop_weak(j).select("symbol")


cte("mal", "SELECT symbol, arg_max(close, trade_date) AS close, arg_max(ma_10, trade_date) AS m10, arg_max(ma_30, trade_date) AS m30, arg_max(ma_60, trade_date) AS m60 FROM i_ma GROUP BY 1", "i_ma")


@query("p05_ma_breakout", sql("mal", "SELECT symbol FROM mal WHERE close>m10 AND (m10>coalesce(m30,'-inf'::DOUBLE) OR (m30 IS NOT NULL AND m30>coalesce(m60,'-inf'::DOUBLE)))"))
def _(v):
    lv = panel.last_rows(trend.sma(v.adj, (10, 30, 60)).select("symbol", "trade_date", "close", "ma_10", "ma_30", "ma_60"))
    return P.ma_breakout(v.ticks.select("symbol"), lv).select("symbol")


@query("p06_universe_restriction", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal>5000)")
def _(v):
    from barloom.sources.bars import scan

    u = v.industry.where("acctbal > 5000")
    t = v.table("lineitem").withColumnRenamed("l_suppkey", "symbol")
    return scan(t, u).select("l_orderkey", "l_linenumber")


@query("p07_reorder_fill", "SELECT p_partkey, p_name, p_size, 'n/a' AS industry FROM part")
def _(v):
    t = P.fill_missing(v.table("part").select("p_size", "p_name", "p_partkey"), {"industry": "n/a", "p_size": 0})
    return P.reorder(t, ["p_partkey", "p_name"])


@query("p08_code_normalise", "SELECT p_partkey, CASE WHEN p_partkey>=1000 THEN lpad(CAST(p_partkey AS VARCHAR),6,'0') ELSE lpad(CAST(p_partkey*1000+600000 AS VARCHAR),6,'0') END AS code FROM part")
def _(v):
    k = F.col("p_partkey")
    raw = F.when(k >= 1000, F.concat(F.lit("x"), k.cast("string"), F.lit(".Z"))).otherwise(F.concat(F.lit("sh"), (k * 1000 + 600000).cast("string"), F.lit("99")))
    return v.table("part").select("p_partkey", T.code(raw).alias("code"))


@query("p09_market_prefix", "SELECT p_partkey, CASE substr(c,1,1) WHEN '6' THEN 'sh' WHEN '0' THEN 'sz' WHEN '3' THEN 'sz' WHEN '4' THEN 'bj' WHEN '8' THEN 'bj' WHEN '9' THEN 'bj' ELSE '' END || c AS code FROM (SELECT p_partkey, lpad(CAST((p_partkey*7919)%1000000 AS VARCHAR),6,'0') AS c FROM part)")
def _(v):
    c = F.lpad(((F.col("p_partkey") * 7919) % 1000000).cast("string"), 6, "0")
    return v.table("part").select("p_partkey", T.market_prefix(c).alias("code"))


@query("p11_raw_prices", sql("bars", f"SELECT symbol, trade_date, {R('close_normal/adj_factor')} AS close FROM bars"))
def _(v):
    rep = v.adj.select("symbol", "trade_date", "close")
    return rounded(P.to_raw_prices(rep, v.bars, ["close"]), "close")


@query("t01_sorted_report", sql("raw", "SELECT symbol, count(*) FILTER (close>open) AS rise_days, count(*) FILTER (volume>40) AS volume_days, 'https://quote.example.com/' || symbol AS link FROM raw GROUP BY 1"))
def _(v):
    g = v.raw.groupBy("symbol").agg(F.count(F.when(F.col("close") > F.col("open"), 1)).alias("rise_days"), F.count(F.when(F.col("volume") > 40, 1)).alias("volume_days"))
    return P.sort_report(g)
