"""Source, merge and probe queries.  The given orders and bars stand in for feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import quality as Q
from barloom.plans.registry import R, cte, query, rounded, sql
from barloom.sources import bars as B, publish as P

KEY = ("symbol", "trade_date")


@query("s01_bar_scan", sql("bars", "SELECT symbol, trade_date, close, close_normal FROM bars WHERE trade_date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' AND symbol IN (SELECT s_suppkey FROM supplier WHERE s_acctbal>0)"))
def _(v):
    return B.scan(v.bars, v.industry.where("acctbal > 0"), "1998-01-01", "1999-12-31").select(*KEY, "close", "close_normal")


@query("s02_replay_scan", sql("bars", "SELECT symbol, trade_date, close FROM bars WHERE trade_date>=DATE '1998-01-01' AND trade_date<=DATE '1998-06-30'"))
def _(v):
    return B.scan(v.bars, None, "1998-01-01", "1999-12-31", replay="1998-06-30").select(*KEY, "close")


@query("s03_bars_from_factor", sql("bars", f"SELECT symbol, trade_date, {R('close*adj_factor', 4)} AS close_normal, volume*100 AS volume, {R('amount*10000', 2)} AS amount FROM bars WHERE volume>5"))
def _(v):
    raw = v.bars.select(*KEY, *B.PRICES, "volume", "amount")
    f = v.bars.select(*KEY, F.when(F.col("volume") > 5, F.col("adj_factor")).alias("adj_factor"))
    return rounded(rounded(B.assemble_from_factor(raw, f).select(*KEY, "close_normal", "volume", "amount"), "close_normal", d=4), "amount", d=2)


@query("s04_bars_from_adjusted", sql("bars", f"SELECT symbol, trade_date, {R('CASE WHEN volume>5 THEN close_normal/close ELSE 1 END')} AS adj_factor, {R('CASE WHEN volume>5 THEN close_normal ELSE close END')} AS close_normal FROM bars"))
def _(v):
    raw = v.bars.select(*KEY, "close")
    adj = v.bars.where("volume > 5").select(*KEY, F.col("close_normal").alias("close"))
    return rounded(B.assemble_from_adjusted(raw, adj).select(*KEY, "adj_factor", "close_normal"), "adj_factor", "close_normal")


# Stored history ends in 2000; the feed overlaps from mid-2000 and restates busy symbols.
cte("st", "SELECT symbol, trade_date, close_normal, adj_factor FROM bars WHERE trade_date<DATE '2001-01-01'", "bars")
cte("rs_", "SELECT s_suppkey AS symbol FROM supplier WHERE s_acctbal>7000")
cte("inc", "SELECT b.symbol, trade_date, close_normal*CASE WHEN r.symbol IS NOT NULL THEN 1.1e0 ELSE 1 END AS close_normal, adj_factor*CASE WHEN r.symbol IS NOT NULL THEN 1.1e0 ELSE 1 END AS adj_factor FROM bars b LEFT JOIN rs_ r ON b.symbol=r.symbol WHERE r.symbol IS NOT NULL OR trade_date>=DATE '2000-07-01'", "bars", "rs_")


def feeds(v):
    b = v.bars.select(*KEY, "close_normal", "adj_factor")
    hot = v.industry.where("acctbal > 7000").select("symbol", F.lit(1.1).alias("k"))
    inc = b.join(hot, "symbol", "left").where("k is not null or trade_date >= '2000-07-01'")
    inc = inc.withColumns({c: F.col(c) * F.coalesce("k", F.lit(1.0)) for c in ("close_normal", "adj_factor")}).drop("k")
    return b.where("trade_date < '2001-01-01'"), inc


@query("s05_incremental_merge", sql("st inc rs_", f"SELECT symbol, trade_date, {R('close_normal')} AS close_normal, {R('adj_factor')} AS adj_factor FROM (SELECT * FROM st WHERE symbol NOT IN (SELECT symbol FROM rs_) UNION ALL SELECT * FROM inc WHERE symbol IN (SELECT symbol FROM rs_) OR trade_date>=DATE '2001-01-01')"))
def _(v):
    return rounded(B.merge_update(*feeds(v)), "close_normal", "adj_factor")


@query("s06_upsert", sql("st inc", f"SELECT symbol, trade_date, {R('close_normal')} AS close_normal, {R('adj_factor')} AS adj_factor FROM (SELECT * FROM st WHERE NOT EXISTS (SELECT 1 FROM inc WHERE inc.symbol=st.symbol AND inc.trade_date=st.trade_date) UNION ALL SELECT * REPLACE (CASE WHEN symbol%2=0 THEN close_normal*0.9e0 ELSE close_normal END AS close_normal) FROM inc)"))
def _(v):
    stored, inc = feeds(v)
    corrected = inc.where("symbol % 2 = 0").withColumn("close_normal", F.col("close_normal") * 0.9).withColumn("version", F.lit(2))
    both = inc.withColumn("version", F.lit(1)).unionByName(corrected)
    return rounded(B.upsert(stored, both, KEY, F.col("version")), "close_normal", "adj_factor")


@query("s09_price_semantics", sql("bars", "SELECT count(*) AS n, 0::BIGINT AS n_contract, count(*) AS n_swapped, 0::BIGINT AS n_missing, 'swap' AS action FROM bars WHERE abs(adj_factor-1)>1e-6"))
def _(v):
    swapped = v.bars.withColumns({"close": F.col("close_normal"), "close_normal": F.col("close")})
    return B.detect_semantics(swapped)


@query("s09_price_repair", sql("bars", f"SELECT symbol, trade_date, {R('close')} AS close, {R('close_normal')} AS close_normal FROM bars"))
def _(v):
    swapped = v.bars.withColumns({x: F.col(y) for p in B.PRICES for x, y in ((p, f"{p}_normal"), (f"{p}_normal", p))})
    return rounded(B.repair_semantics(swapped).select(*KEY, "close", "close_normal"), "close", "close_normal")


@query("s10_strategy_archive", "SELECT DISTINCT l_suppkey AS symbol, CASE WHEN l_returnflag='R' THEN 'returned' ELSE 'kept' END AS strategy, DATE '2001-11-05' AS archive_date FROM lineitem")
def _(v):
    t = v.table("lineitem").withColumnRenamed("l_suppkey", "symbol")
    return B.archive_lists({"returned": t.where("l_returnflag = 'R'"), "kept": t.where("l_returnflag <> 'R'")}, "2001-11-05")


# A report with real faults: every seventh code is lost, prices of one region are text, one region has no name.
cte(
    "rep",
    """SELECT CASE WHEN symbol%7<>0 THEN CAST(symbol AS VARCHAR) END AS code, CASE WHEN l1<>'ASIA' THEN name END AS name, l1 AS industry,
    CASE WHEN l1='EUROPE' THEN '--' ELSE CAST(acctbal AS VARCHAR) END AS last_price, CAST(symbol%5 AS VARCHAR) AS rise_days, acctbal FROM industry""",
    "industry",
)


def report(v):
    i = v.industry
    return i.select(
        F.when(F.col("symbol") % 7 != 0, F.col("symbol").cast("string")).alias("code"),
        F.when(F.col("l1") != "ASIA", F.col("name")).alias("name"),
        F.col("l1").alias("industry"),
        F.when(F.col("l1") == "EUROPE", "--").otherwise(F.col("acctbal").cast("string")).alias("last_price"),
        (F.col("symbol") % 5).cast("string").alias("rise_days"),
        "acctbal",
    )


_ABSENT = "['industry_signal','strong','price_volume','volume_days','trend','link']"


@query(
    "s12_report_gate",
    sql("rep", f"""SELECT code AS key, 'code' AS "column", 'null' AS problem FROM rep WHERE code IS NULL UNION ALL SELECT code, 'name', 'null' FROM rep WHERE name IS NULL
    UNION ALL SELECT code, 'last_price', 'not double' FROM rep WHERE last_price='--' UNION ALL SELECT NULL, unnest({_ABSENT}), 'missing column'"""),
)
def _(v):
    return Q.violations(report(v), Q.CONTRACTS["final_report"], "code")


@query(
    "s12_published_report",
    sql("rep", """SELECT CAST(code AS VARCHAR) AS stock_code, name AS stock_name, industry, CASE WHEN last_price='--' THEN 0e0 ELSE CAST(last_price AS DOUBLE) END AS close_price, CAST(rise_days AS BIGINT) AS consecutive_up_days
    FROM rep WHERE code IS NOT NULL AND name IS NOT NULL"""),
)
def _(v):
    """The broken report is refused; what is whole of it is projected, published, and read back."""
    from barloom.operators.report import projected

    root = _folder(v, "report")
    names = {"code": "stock_code", "name": "stock_name", "industry": "industry", "last_price": "close_price", "rise_days": "consecutive_up_days"}
    contract = [Q.Rule("stock_code", nullable=False), Q.Rule("stock_name", nullable=False), Q.Rule("close_price", "double", nullable=False)]
    final = projected(report(v), names, money=("close_price",), whole=("consecutive_up_days",), key="stock_code", order=F.col("acctbal"))
    try:
        P.publish(final, root, "day-1", ["stock_code"], "industry", contract)
    except P.Rejected:
        whole = final.where("stock_code is not null and stock_name is not null")
        P.publish(whole, root, "day-1", ["stock_code"], "industry", contract)
    return P.published(v.spark, root)


@query("s13_probes", sql("raw", "SELECT max(trade_date) AS latest, count(DISTINCT symbol) AS n_keys, count(*) AS n_rows FROM raw"))
def _(v):
    return B.probes(v.raw)


@query("s14_stale_symbols", sql("raw", "SELECT s_suppkey AS symbol, latest FROM supplier LEFT JOIN (SELECT symbol, max(trade_date) AS latest FROM raw GROUP BY 1) ON symbol=s_suppkey WHERE latest IS NULL OR latest<DATE '2001-10-25'"))
def _(v):
    return B.stale(v.raw, v.industry, "2001-10-25")


@query("s15_research_coverage", "SELECT s_suppkey AS symbol FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_discount>=0.09 GROUP BY 1 HAVING count(*)>=100)")
def _(v):
    rep = v.table("lineitem").where("l_discount >= 0.09").select(F.col("l_suppkey").alias("symbol"))
    return B.covered(v.industry.select("symbol"), rep, 100)


@query("s15_main_board", "SELECT p_partkey FROM (SELECT p_partkey, lpad(CAST((p_partkey*7919)%1000000 AS VARCHAR),6,'0') AS c FROM part) WHERE substr(c,1,3) IN ('600','601','603','605','000','001','002','003')")
def _(v):
    t = v.table("part").select("p_partkey", F.lpad(((F.col("p_partkey") * 7919) % 1000000).cast("string"), 6, "0").alias("code"))
    return B.main_board(t).select("p_partkey")


@query("s16_duplicate_keys", "SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS trade_date, count(*) AS copies FROM lineitem GROUP BY 1,2 HAVING count(*)>1")
def _(v):
    return B.duplicate_keys(v.trades, KEY)


def _published_bars(v):
    """Bars by year in three batches: all, a year restated, and one with repeated keys, which is refused."""
    root = _folder(v, "bars")
    b = v.bars.select(*KEY, "close", F.year("trade_date").alias("year"))
    P.publish(b, root, "first", KEY, "year")
    P.publish(b.where("year = 1998").withColumn("close", F.col("close") * 2), root, "restated", KEY, "year")
    broken = b.where("year = 1999")
    try:
        P.publish(broken.unionByName(broken.withColumn("close", F.col("close") * 3)), root, "broken", KEY, "year")
    except P.Rejected:
        pass
    return root


@query("s16_published_bars", sql("bars", f"SELECT symbol, trade_date, {R('close*CASE WHEN year(trade_date)=1998 THEN 2 ELSE 1 END')} AS close FROM bars"))
def _(v):
    return rounded(P.published(v.spark, _published_bars(v)).select(*KEY, "close"), "close")


@query("s16_manifest", sql("bars", "SELECT CAST(year(trade_date) AS VARCHAR) AS part, CASE WHEN year(trade_date)=1998 THEN 'restated' ELSE 'first' END AS batch, count(*) AS n_rows FROM bars GROUP BY 1,2"))
def _(v):
    return P.manifest(v.spark, _published_bars(v)).select("part", "batch", "n_rows")


@query("s16_merge_report", "SELECT year(o_orderdate) AS run, count(*) AS parts, " + R("avg(CASE WHEN o_orderstatus='F' THEN 1e0 ELSE 0e0 END)") + " AS success_rate FROM orders GROUP BY 1")
def _(v):
    m = v.table("orders").select(F.year("o_orderdate").cast("bigint").alias("run"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failed").alias("status"))
    return rounded(B.merge_report(m), "success_rate")


def _folder(v, name: str) -> str:
    """A new folder beside the shared checkpoints."""
    import uuid

    from barloom.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(v.spark)}/{name}-{uuid.uuid4().hex}"


@query("s07_replace_dates", sql("bars", f"SELECT symbol, trade_date, {R('close*CASE WHEN year(trade_date)=1998 THEN 2 ELSE 1 END')} AS close FROM bars"))
def _(v):
    path = _folder(v, "replaced")
    b = v.bars.select(*KEY, "close", F.date_format("trade_date", "yyyy-MM").alias("month"))
    B.replace_dates(b, path, "month")
    B.replace_dates(b.where("year(trade_date) = 1998").withColumn("close", F.col("close") * 2), path, "month")
    return rounded(v.spark.read.parquet(path).select(*KEY, "close"), "close")


@query("s08_truncate_insert", sql("bars", f"SELECT symbol, trade_date, {R('close')} AS close FROM bars WHERE year(trade_date)=1999"))
def _(v):
    path = _folder(v, "truncated")
    b = v.bars.select(*KEY, "close")
    B.truncate_insert(b.where("year(trade_date) = 1998"), path)
    B.truncate_insert(b.where("year(trade_date) = 1999"), path)
    return rounded(v.spark.read.parquet(path), "close")


@query("s11_industry_projection", """SELECT n_name AS industry_name, r_name AS sector, CAST(round(sum(CAST(s_acctbal AS DECIMAL(18,2)))*10000,2) AS DOUBLE) AS market_value FROM supplier
    JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY 1,2""")
def _(v):
    from barloom.functions.text import money

    g = v.industry.groupBy("l1", "l2").agg(F.sum(F.col("acctbal").cast("decimal(18,2)")).alias("total"))
    mv = F.concat(F.col("total").cast("string"), F.lit("万"))
    return g.select(F.col("l2").alias("industry_name"), F.col("l1").alias("sector"), F.round(money(mv), 2).alias("market_value"))


@query("q01_required_columns", sql("bars", "SELECT unnest(['suspended','vwap']) AS missing, (SELECT count(*) FROM bars) AS n_rows"))
def _(v):
    missing = Q.required_columns(v.bars, [*Q.OHLCV, "suspended", "vwap"])
    return v.bars.agg(F.count(F.lit(1)).alias("n_rows")).select(F.explode(F.array(*[F.lit(m) for m in missing])).alias("missing"), "n_rows")


@query(
    "e01_event_time_bars",
    sql("ticks", "SELECT symbol, trade_date, arg_min(px, seq) AS open, max(px) AS high, min(px) AS low, arg_max(px, seq) AS close, CAST(sum(CAST(qty AS BIGINT)) AS BIGINT) AS volume, CAST(sum(CAST(amt AS DECIMAL(18,2))) AS DOUBLE) AS amount, count(*) AS n_ticks FROM ticks GROUP BY symbol, trade_date"),
)
def _(v):
    """All ticks in three deliveries; a fifth of the ticks of a delivery's last ten days comes with the next one."""
    from barloom.streaming import bars as S

    raw, out, checkpoint = (_folder(v, name) for name in ("ticks", "event-bars", "event-state"))
    t = v.ticks.withColumn("ts", F.col("ts").cast("timestamp"))
    cuts = [F.lit(d).cast("timestamp") for d in ("1997-07-01", "2000-01-01")]
    due = sum((F.col("ts") >= c).cast("int") for c in cuts)
    held = [(F.col("ts") >= c - F.expr("interval 10 days")) & (F.col("ts") < c) for c in cuts]
    t = t.withColumn("delivery", due + ((F.col("seq") % 5 == 0) & (held[0] | held[1])).cast("int"))
    end = v.ticks.agg(F.lit(-1).cast("bigint").alias("symbol"), (F.max("ts").cast("timestamp") + F.expr("interval 60 days")).alias("ts"), F.lit(0).cast("bigint").alias("seq"))
    deliveries = [t.where(F.col("delivery") == k).drop("delivery") for k in range(3)]
    for part in [*deliveries, end.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in t.dtypes[3:-1]])]:
        part.select("symbol", "ts", "seq", "px", "qty", "amt").write.mode("append").parquet(raw)
        stream = v.spark.readStream.schema(v.spark.read.parquet(raw).schema).parquet(raw)
        S.drain(S.bars_on_event_time(stream, "15 days", price="px", volume="qty", amount="amt"), out, checkpoint)
    return v.spark.read.parquet(out)
