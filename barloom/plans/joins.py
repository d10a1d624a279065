"""Join queries over the panel views."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import joins as J, portfolio as P
from barloom.plans.registry import R, cte, lag, query, r, rounded, sql


@query(
    "j01_name_resolution",
    """WITH u AS (SELECT s_suppkey AS symbol, CASE WHEN s_acctbal>6000 THEN s_name END AS name, 0 AS p FROM supplier
    UNION ALL SELECT l_suppkey, min(CASE WHEN l_quantity=50 AND l_discount>0.08 THEN 'line ' || l_suppkey END), 1 FROM lineitem GROUP BY 1
    UNION ALL SELECT s_suppkey, n_name, 2 FROM supplier JOIN nation ON s_nationkey=n_nationkey)
    SELECT symbol, arg_min(name, p) AS name FROM u WHERE trim(coalesce(name,''))<>'' GROUP BY 1""",
)
def _(v):
    a = v.industry.select("symbol", F.when(F.col("acctbal") > 6000, F.col("name")).alias("name"))
    b = v.table("lineitem").where("l_quantity = 50 and l_discount > 0.08").select(F.col("l_suppkey").alias("symbol")).distinct()
    b = b.withColumn("name", F.concat(F.lit("line "), F.col("symbol").cast("string")))
    return J.first_name([a, b, v.industry.select("symbol", F.col("l2").alias("name"))])


@query(
    "j02_consolidated_report",
    sql(
        "fund daily_flow",
        """SELECT f.symbol, f.name, f.l1, n_trades, max_net, last_net FROM fund f LEFT JOIN (SELECT symbol, max(net) AS max_net FROM daily_flow GROUP BY 1) a ON a.symbol=f.symbol
        LEFT JOIN (SELECT symbol, arg_max(net, trade_date) AS last_net FROM daily_flow GROUP BY 1) b ON b.symbol=f.symbol""",
    ),
)
def _(v):
    a = v.daily_flow.groupBy("symbol").agg(F.max("net").alias("max_net"))
    newest_first = v.daily_flow.select("symbol", (-F.unix_date("trade_date")).alias("age"), F.col("net").alias("last_net"))
    return J.consolidate(v.industry.select("symbol", "name", "l1"), [v.fund.select("symbol", "n_trades"), a, newest_first], order="age")


@query("j03_membership_flag", "SELECT s_suppkey AS symbol, CASE WHEN s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity=50 AND l_discount>=0.08) THEN 'yes' ELSE 'no' END AS strong FROM supplier")
def _(v):
    strong = v.table("lineitem").where("l_quantity = 50 and l_discount >= 0.08").select(F.col("l_suppkey").alias("symbol"))
    return J.membership(v.industry.select("symbol"), strong, "strong")


@query("j04_join_by_name", "SELECT n_name AS name, r_name AS region, count(s_suppkey) AS n_symbols FROM nation LEFT JOIN region ON n_regionkey=r_regionkey LEFT JOIN supplier ON s_nationkey=n_nationkey GROUP BY 1,2")
def _(v):
    names = v.industry.select("symbol", F.col("l2").alias("name"))
    base = v.table("nation").join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_name").alias("name"), F.col("r_name").alias("region"))
    return base.join(names, "name", "left").groupBy("name", "region").agg(F.count("symbol").alias("n_symbols"))


@query("j05_as_of_date", sql("quality", "SELECT symbol, record_date, disclosure_date, revenue, n_orders FROM quality WHERE disclosure_date<=DATE '1998-06-30' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY record_date DESC)=1"))
def _(v):
    return J.as_of(v.quality, F.lit("1998-06-30").cast("date")).select("symbol", "record_date", "disclosure_date", "revenue", "n_orders")


@query(
    "j05_as_of_each_row",
    sql("quality", """SELECT o.o_orderkey AS id, q.record_date, q.revenue FROM orders o LEFT JOIN LATERAL (SELECT record_date, revenue FROM quality q
        WHERE q.symbol=o.o_custkey AND q.disclosure_date<=CAST(o.o_orderdate AS DATE) ORDER BY record_date DESC LIMIT 1) q ON true"""),
)
def _(v):
    probes = v.table("orders").select(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"))
    return J.as_of_each(probes, v.quality, "at", ["revenue"]).select("id", "record_date", "revenue")


@query("j06_exact_date_lookup", sql("raw trades", "SELECT t.symbol, t.seq, r.close, r.volume FROM trades t JOIN raw r ON t.symbol=r.symbol AND t.trade_date=r.trade_date"))
def _(v):
    return v.trades.select("symbol", "trade_date", "seq").join(v.raw.select("symbol", "trade_date", "close", "volume"), ["symbol", "trade_date"]).select("symbol", "seq", "close", "volume")


cte("sgn", "SELECT symbol, trade_date, volume*1e0 AS score, close AS stop_loss, 'HIGH' AS risk_level FROM raw WHERE volume>40", "raw")


@query(
    "j07_signal_merge",
    sql("raw sgn", """SELECT r.symbol, r.trade_date, coalesce(s.score,0) AS score, coalesce(last_value(s.stop_loss IGNORE NULLS) OVER (PARTITION BY r.symbol ORDER BY r.trade_date),0) AS stop_loss,
        coalesce(s.risk_level,'LOW') AS risk_level FROM raw r LEFT JOIN sgn s ON r.symbol=s.symbol AND r.trade_date=s.trade_date"""),
)
def _(v):
    sig = v.raw.where("volume > 40").select("symbol", "trade_date", F.col("volume").cast("double").alias("score"), F.col("close").alias("stop_loss"), F.lit("HIGH").alias("risk_level"))
    return J.merge_signals(v.raw.select("symbol", "trade_date"), sig, ["score"])


# Status changes derived from orders: the customer is the security, the status text its name.
cte("chg", "SELECT o_custkey%(SELECT count(*) FROM supplier) AS symbol, CAST(o_orderdate AS DATE) AS change_date, max(o_orderstatus='F') AS is_st, max(o_orderpriority='5-LOW') AS is_delisting FROM orders GROUP BY 1,2")
cte(
    "ivl",
    """SELECT symbol, change_date AS start_date, e AS end_date, is_st, is_delisting FROM (SELECT *, lead(change_date) OVER (PARTITION BY symbol ORDER BY change_date) AS e FROM (
    SELECT *, lag(is_st::INT*2+is_delisting::INT) OVER (PARTITION BY symbol ORDER BY change_date) AS p FROM chg) WHERE p IS NULL OR p<>is_st::INT*2+is_delisting::INT) WHERE is_st OR is_delisting""",
    "chg",
)


def intervals(v):
    n = v.table("supplier").agg(F.count(F.lit(1))).scalar()
    chg = v.table("orders").select((F.col("o_custkey") % n).alias("symbol"), F.to_date("o_orderdate").alias("change_date"), "o_orderstatus", "o_orderpriority")
    return J.status_intervals(chg, F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "5-LOW")


@query("j09_status_intervals", sql("ivl", "SELECT * FROM ivl"))
def _(v):
    return intervals(v)


cte("ivd", "SELECT r.symbol, r.trade_date, is_st, is_delisting FROM raw r JOIN ivl i ON r.symbol=i.symbol AND r.trade_date>=start_date AND (end_date IS NULL OR r.trade_date<end_date)", "raw", "ivl")


@query("j08_interval_expansion", sql("ivd", "SELECT * FROM ivd"))
def _(v):
    return J.expand_intervals(intervals(v), v.raw)


@query("j10_day_state", sql("ivd raw", "SELECT r.symbol, r.trade_date, coalesce(is_st,false) AS is_st, coalesce(is_delisting,false) AS is_delisting FROM raw r LEFT JOIN ivd USING (symbol, trade_date)"))
def _(v):
    return J.day_state(v.raw.select("symbol", "trade_date"), J.expand_intervals(intervals(v), v.raw))


cte("dl", "SELECT s_suppkey AS symbol, DATE '1998-01-01' + CAST(s_suppkey%900 AS INT) AS delist_date FROM supplier")


@query(
    "j11_delisting_window",
    sql("raw dl", """SELECT symbol, trade_date, delist_date FROM (SELECT r.symbol, r.trade_date, delist_date, row_number() OVER (PARTITION BY r.symbol ORDER BY r.trade_date DESC) AS n
        FROM raw r JOIN dl ON r.symbol=dl.symbol WHERE r.trade_date<=delist_date) WHERE n<=CASE WHEN delist_date<DATE '1998-02-01' THEN 30 ELSE 15 END"""),
)
def _(v):
    d = v.industry.select("symbol", F.date_add(F.lit("1998-01-01").cast("date"), (F.col("symbol") % 900).cast("int")).alias("delist_date"))
    return J.delisting_window(v.raw, d, reform="1998-02-01")


@query("j12_listing_age", sql("raw dl", "SELECT r.symbol, r.trade_date, delist_date AS ipo_date, row_number() OVER (PARTITION BY r.symbol ORDER BY r.trade_date) AS listing_days FROM raw r JOIN dl ON r.symbol=dl.symbol WHERE r.trade_date>=delist_date"))
def _(v):
    d = v.industry.select("symbol", F.date_add(F.lit("1998-01-01").cast("date"), (F.col("symbol") % 900).cast("int")).alias("ipo_date"))
    return J.listing_age(v.raw, d)


@query("j13_industry_signal", "SELECT s_suppkey AS symbol, coalesce(CASE WHEN r_regionkey<>2 THEN 'sig ' || r_name END,'') AS industry_signal FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey")
def _(v):
    sig = v.table("region").where("r_regionkey <> 2").select(F.trim("r_name").alias("k"), F.concat(F.lit("sig "), "r_name").alias("industry_signal"))
    sig = sig.groupBy("k").agg(F.min("industry_signal").alias("industry_signal"))
    return v.industry.join(sig, F.trim("l1") == F.col("k"), "left").select("symbol", F.coalesce("industry_signal", F.lit("")).alias("industry_signal"))


@query(
    "j14_benchmark_universe",
    "SELECT coalesce(s.s_suppkey, c.c_custkey) AS symbol, coalesce(n.n_name, 'unknown') AS industry, coalesce(c.c_acctbal, 0) AS holding FROM (SELECT * FROM supplier JOIN nation ON s_nationkey=n_nationkey) s FULL JOIN (SELECT * FROM customer WHERE c_mktsegment='BUILDING') c ON s.s_suppkey=c.c_custkey LEFT JOIN nation n ON n.n_nationkey=s.s_nationkey",
)
def _(v):
    hold = v.table("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("symbol"), F.col("c_acctbal").alias("holding"))
    return hold.join(v.industry.select("symbol", F.col("l2").alias("industry")), "symbol", "full_outer").select(
        "symbol", F.coalesce("industry", F.lit("unknown")).alias("industry"), F.coalesce("holding", F.lit(0.0)).alias("holding")
    )


cte("wt", "SELECT s_suppkey AS symbol, s_acctbal/5e4 AS weight FROM supplier WHERE s_acctbal>0")
cte("wp", "SELECT s_suppkey AS symbol, (1e4-s_acctbal)/5e4 AS weight FROM supplier WHERE s_acctbal<6000")
cte("wal", "SELECT coalesce(t.symbol,p.symbol) AS symbol, coalesce(t.weight,0) AS target, coalesce(p.weight,0) AS previous FROM wt t FULL JOIN wp p ON t.symbol=p.symbol", "wt", "wp")


def weights(v):
    s = v.industry.select("symbol", "acctbal")
    t = s.where("acctbal > 0").withColumn("weight", F.col("acctbal") / 5e4)
    p = s.where("acctbal < 6000").withColumn("weight", (1e4 - F.col("acctbal")) / 5e4)
    return P.align_weights(t, p)


@query("j16_weight_alignment", sql("wal", "SELECT * FROM wal"))
def _(v):
    return weights(v)


@query("x37_turnover_cap", sql("wal", f"""SELECT symbol, {R('CASE WHEN t>0.5 AND s>0.95 THEN w*0.95e0/s ELSE w END')} AS weight FROM (SELECT *, sum(w) OVER () AS s FROM (
    SELECT *, previous+(target-previous)*CASE WHEN t>0.5 THEN 0.5e0/t ELSE 1 END AS w FROM (SELECT *, sum(abs(target-previous)) OVER ()/2 AS t FROM wal)))"""))
def _(v):
    return P.cap_turnover(weights(v)).select("symbol", r("weight").alias("weight"))


@query("x38_rebalance_cost", sql("wal", f"SELECT symbol, {R('CASE WHEN abs(target-previous)<1e-8 THEN 0 ELSE abs(target-previous)*(0.0003e0*2+CASE WHEN target<previous THEN 0.0005e0 ELSE 0 END+0.00001e0*2) END', 9)} AS cost FROM wal"))
def _(v):
    return weights(v).select("symbol", r(P.rebalance_cost(F.col("target"), F.col("previous")), 9).alias("cost"))


cte("rr", f"SELECT symbol, trade_date, close/{lag('close')}-1 AS ret FROM adj", "adj")


@query("j15_aligned_returns", sql("rr", f"SELECT a.symbol, trade_date, {R('a.ret')} AS ret_a, {R('b.ret')} AS ret_b FROM rr a JOIN (SELECT trade_date, avg(ret) AS ret FROM rr GROUP BY 1) b USING (trade_date) WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL"))
def _(v):
    from barloom.operators.risk import aligned, simple_returns

    rets = simple_returns(v.adj)
    b = rets.groupBy("trade_date").agg(F.avg("ret").alias("ret"))
    return rounded(aligned(rets, b), "ret_a", "ret_b")


@query("j17_trade_to_bar", sql("trades raw", "SELECT t.symbol, t.seq, t.price, r.low, r.high, t.price BETWEEN r.low AND r.high AS inside FROM trades t LEFT JOIN raw r ON t.symbol=r.symbol AND t.trade_date=r.trade_date WHERE r.close IS NOT NULL"))
def _(v):
    j = v.trades.join(v.raw.select("symbol", "trade_date", "low", "high", "close"), ["symbol", "trade_date"], "left").where("close is not null")
    return j.select("symbol", "seq", "price", "low", "high", F.col("price").between(F.col("low"), F.col("high")).alias("inside"))


cte("cal", "SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS p FROM (SELECT DISTINCT trade_date FROM raw)", "raw")
cte("spn", "SELECT symbol, min(trade_date) AS a, max(trade_date) AS z, count(*) AS n FROM raw GROUP BY 1", "raw")
cte("miss", "SELECT s.symbol, c.trade_date FROM spn s JOIN cal c ON c.trade_date BETWEEN a AND z ANTI JOIN raw r ON r.symbol=s.symbol AND r.trade_date=c.trade_date", "spn", "cal")


@query("j19_missing_days", sql("miss", "SELECT symbol, trade_date FROM miss"))
def _(v):
    return J.missing_days(v.raw, v.raw)


@query("u03_calendar_difference", sql("miss", "SELECT trade_date, count(*) AS n_missing FROM miss GROUP BY 1"))
def _(v):
    return J.missing_days(v.raw, v.raw).groupBy("trade_date").agg(F.count(F.lit(1)).alias("n_missing"))


cte("gaps", "SELECT symbol, count(*) FILTER (g>0) AS nb, coalesce(max(g) FILTER (g>0),0) AS lb FROM (SELECT r.symbol, c.p-lag(c.p) OVER (PARTITION BY r.symbol ORDER BY c.p)-1 AS g FROM raw r JOIN cal c USING (trade_date)) GROUP BY 1", "raw", "cal")
cte(
    "susp",
    """SELECT s.symbol, z.p-a.p+1 AS span_days, z.p-a.p+1-n AS missing_days, (SELECT max(p) FROM cal)-z.p AS tail_days, nb AS n_blocks, lb AS longest_block,
    (SELECT count(*) FROM miss m WHERE m.symbol=s.symbol AND year(m.trade_date)=1997) AS confirmed_days
    FROM spn s JOIN cal a ON a.trade_date=s.a JOIN cal z ON z.trade_date=s.z JOIN gaps g ON g.symbol=s.symbol""",
    "spn",
    "cal",
    "gaps",
    "miss",
)


@query("a33_suspension_stats", sql("susp", f"SELECT *, missing_days-confirmed_days AS under_collected_days, {R('missing_days/span_days')} AS suspension_ratio, {R('confirmed_days/span_days')} AS confirmed_ratio FROM susp"))
def _(v):
    confirmed = v.raw.where("year(trade_date) = 1997")
    return rounded(J.suspension_stats(v.raw, v.raw, confirmed), "suspension_ratio", "confirmed_ratio")


@query("a34_suspension_suspects", sql("susp", f"SELECT symbol, {R('missing_days/span_days')} AS suspension_ratio FROM susp WHERE missing_days/span_days>0.79"))
def _(v):
    return J.suspects(J.suspension_stats(v.raw, v.raw), 0.79).select("symbol", r("suspension_ratio").alias("suspension_ratio"))


@query("u01_union_first_wins", "SELECT k AS symbol, arg_min(src, p) AS src FROM (SELECT l_suppkey AS k, 'lineitem' AS src, 0 AS p FROM lineitem WHERE l_quantity=50 AND l_discount>=0.08 UNION ALL SELECT s_suppkey, 'supplier', 1 FROM supplier) GROUP BY 1")
def _(v):
    a = v.table("lineitem").where("l_quantity = 50 and l_discount >= 0.08").select(F.col("l_suppkey").alias("symbol"), F.lit("lineitem").alias("name"))
    return J.first_name([a, v.industry.select("symbol", F.lit("supplier").alias("name"))]).withColumnRenamed("name", "src")


@query("u02_index_intersection", "SELECT DISTINCT l_suppkey AS symbol FROM lineitem WHERE l_quantity=50 AND l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_discount>=0.1)")
def _(v):
    t = v.table("lineitem").select(F.col("l_suppkey").alias("symbol"), "l_quantity", "l_discount")
    return t.where("l_quantity = 50").join(t.where("l_discount >= 0.1"), "symbol", "left_semi").select("symbol").distinct()


@query("u05_symbol_union", "SELECT l_suppkey AS symbol FROM lineitem WHERE l_shipdate>=TIMESTAMP '2001-01-01' UNION SELECT c_custkey FROM customer WHERE c_acctbal<0")
def _(v):
    a = v.table("lineitem").where("l_shipdate >= '2001-01-01'").select(F.col("l_suppkey").alias("symbol"))
    return a.unionByName(v.table("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("symbol"))).distinct()
