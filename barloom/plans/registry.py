"""Query registry and the shared SQL views of the check side."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.operators import panel, trend


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[["Views"], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql)
        return fn

    return add


def cte(name: str, text: str, *deps: str) -> None:
    CTES[name] = (deps, text)


def sql(deps: str, body: str) -> str:
    """Prefix `body` with the named views (space separated) and what they need.
    A body that starts with a comma continues the WITH list."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in CTES[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for d in deps.split():
        visit(d)
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order) + " " + body


def R(expr: str, d: int = 6) -> str:
    """Output rounding, SQL side.  The 0.0137 keeps exact decimal ties off the boundary, so
    the last bit of a sum cannot flip the digit; both sides use the same arithmetic."""
    return f"(floor(({expr})*1e{d}+0.5137e0)/1e{d})"


def r(c: Column | str, d: int = 6) -> Column:
    """Output rounding, Spark side."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * float(10**d) + 0.5137) / float(10**d)


def rounded(df: DataFrame, *cols: str, d: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, d) for c in cols})


def Rs(cols: str, d: int = 6, prefix: str = "") -> str:
    """SQL select list of rounded columns."""
    return ", ".join(f"{R(prefix + c, d)} AS {c}" for c in cols.split())


class Views:
    """Panel views over the given tables; each is a lazy plan."""

    BASE_YEAR = 1995

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def ticks(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("symbol"),
            F.col("l_shipdate").alias("ts"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
            panel.tick(F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
            F.col("l_quantity").alias("qty"),
            F.col("l_extendedprice").alias("amt"),
        )

    def _bars(self, ticks: DataFrame, *more: Column) -> DataFrame:
        raw = panel.bars_from_ticks(ticks, *more, symbol="symbol", ts="ts", seq="seq", price="px", volume="qty", amount="amt")
        return panel.with_adjusted(raw, 1 + F.lit(0.05) * (F.year("trade_date") - self.BASE_YEAR))

    @cached_property
    def bars(self) -> DataFrame:
        return self._bars(self.ticks)

    @cached_property
    def _most_ticks(self) -> int:
        """Ticks of the symbol that has most, from a scan of one column."""
        return self.table("lineitem").groupBy("l_suppkey").count().agg(F.max("count")).first()[0] or 0

    def _histories(self, columns: Sequence[str] = (), *more: Column) -> DataFrame:
        """`adj` with `more` summed up of a day's ticks, dealt by symbol.

        Ticks are dealt themselves, so they are shuffled once for bars and for histories, and by all that reads
        histories.  Where a symbol has too many for a task, its days are summed up before the shuffle instead."""
        t = self.table("lineitem")
        rows = t.count()  # from the files' footers; no fewer than bars
        ticks = t.select(
            F.col("l_suppkey").alias("symbol"),
            F.col("l_shipdate").alias("ts"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
            F.col("l_quantity").alias("qty"),
            F.col("l_extendedprice").alias("amt"),
            *columns,
        )
        hot = self._most_ticks > panel.HOT_TICKS
        ticks = (ticks if hot else panel.dealt(ticks, rows)).withColumn("px", panel.tick(F.col("amt") / F.col("qty")))
        bars = panel.with_price_space(self._bars(ticks, *more), "adj")
        return panel.dealt(bars, rows) if hot else bars

    @cached_property
    def adj(self) -> DataFrame:
        """Bars in adjusted price space."""
        return panel.with_price_space(self.bars, "adj")

    @cached_property
    def histories(self) -> DataFrame:
        """`adj`, dealt by symbol for windows over histories."""
        return self._histories()

    @cached_property
    def flows(self) -> DataFrame:
        """`histories` with the day's trades beside each bar, summed up in the same pass, so nothing is joined: net
        money flow, that of large and of small orders, and the shares sold."""
        sells, qty, value = F.coalesce(F.col("l_returnflag") == "R", F.lit(False)), F.col("qty").cast("bigint"), F.col("amt").cast("decimal(18,2)")
        signed = F.when(sells, -value).otherwise(value)
        total = lambda c, name: F.sum(c).cast("double").alias(name)
        sums = total(signed, "net"), total(F.when(qty >= 30, signed), "large_net"), total(F.when(qty < 15, signed), "small_net")
        return self._histories(["l_returnflag"], *sums, F.sum(F.when(sells, qty)).alias("sold"))

    @cached_property
    def raw(self) -> DataFrame:
        return panel.with_price_space(self.bars, "raw")

    @cached_property
    def ind(self) -> DataFrame:
        return trend.indicators(self.histories)

    @cached_property
    def industry(self) -> DataFrame:
        return (
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("s_suppkey").alias("symbol"),
                F.col("s_name").alias("name"),
                F.col("r_name").alias("l1"),
                F.col("n_name").alias("l2"),
                F.col("s_acctbal").alias("acctbal"),
            )
        )


    @cached_property
    def fund(self) -> DataFrame:
        """Fundamentals per symbol, with its industry."""
        mean = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))
        f = self.table("lineitem").groupBy(F.col("l_suppkey").alias("symbol")).agg(
            (mean("l_discount") * 100).alias("roe"),
            (mean("l_tax") * 100).alias("gross_profit_margin"),
            mean("l_quantity").alias("net_profit_margin"),
            (F.sum((F.col("l_returnflag") == "R").cast("int")) / F.count(F.lit(1)) * 100).alias("revenue_growth"),
            (F.sum((F.col("l_linestatus") == "O").cast("int")) / F.count(F.lit(1)) * 100).alias("net_profit_growth"),
            F.max("l_extendedprice").alias("top_price"),
            F.count(F.lit(1)).alias("n_trades"),
        )
        return self.industry.join(f, "symbol").withColumn("pe_ttm", F.col("acctbal") / 50).withColumn("pb", F.col("acctbal") / 100)

    @cached_property
    def daily_flow(self) -> DataFrame:
        """Net money flow per symbol and day: buys less sells."""
        v = F.col("value").cast("decimal(18,2)")
        return self.trades.groupBy("symbol", "trade_date").agg(
            F.sum(F.when(F.col("action") == "buy", v).otherwise(-v)).cast("double").alias("net")
        )

    @cached_property
    def index_bars(self) -> DataFrame:
        return self.adj.groupBy("trade_date").agg(
            *[F.avg(c).alias(c) for c in panel.PRICES], F.sum("volume").alias("volume")
        )

    @cached_property
    def trades(self) -> DataFrame:
        """Trade log: buys and sells per symbol in time order."""
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("symbol"),
            F.to_date("l_shipdate").alias("trade_date"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
            F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("action"),
            F.col("l_quantity").cast("bigint").alias("qty"),
            panel.tick(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_extendedprice").alias("value"),
            F.col("l_discount").alias("discount"),
        )

    @cached_property
    def quality(self) -> DataFrame:
        """Quarterly fundamentals per customer, with the disclosure deadline."""
        from barloom.functions.dates import disclosure_deadline, quarter_end

        o = self.table("orders")
        return (
            o.groupBy(F.col("o_custkey").alias("symbol"), quarter_end(F.to_date("o_orderdate")).alias("record_date"))
            .agg(
                F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("revenue"),
                F.count(F.lit(1)).alias("n_orders"),
                F.max("o_totalprice").alias("largest"),
            )
            .withColumn("disclosure_date", disclosure_deadline(F.col("record_date")))
        )


PX = "floor(l_extendedprice/l_quantity*100+0.5e0)/100"
cte(
    "ticks",
    f"""SELECT l_suppkey AS symbol, l_shipdate AS ts, CAST(l_shipdate AS DATE) AS trade_date,
    l_orderkey*8+l_linenumber AS seq, {PX} AS px, l_quantity AS qty, l_extendedprice AS amt FROM lineitem""",
)
cte(
    "bars",
    """SELECT *, open*adj_factor AS open_normal, high*adj_factor AS high_normal, low*adj_factor AS low_normal,
    close*adj_factor AS close_normal FROM (
    SELECT symbol, trade_date, arg_min(px, seq) AS open, max(px) AS high, min(px) AS low, arg_max(px, seq) AS close,
    CAST(sum(CAST(qty AS BIGINT)) AS BIGINT) AS volume,
    CAST(sum(CAST(amt AS DECIMAL(18,2))) AS DOUBLE) AS amount,
    1e0+5e-2*(year(trade_date)-1995) AS adj_factor FROM ticks GROUP BY symbol, trade_date)""",
    "ticks",
)
cte(
    "adj",
    """SELECT symbol, trade_date, open_normal AS open, high_normal AS high, low_normal AS low, close_normal AS close,
    volume, amount, adj_factor, row_number() OVER (PARTITION BY symbol ORDER BY trade_date)-1 AS i FROM bars""",
    "bars",
)
cte(
    "raw",
    """SELECT symbol, trade_date, open, high, low, close, volume, amount, adj_factor,
    row_number() OVER (PARTITION BY symbol ORDER BY trade_date)-1 AS i FROM bars""",
    "bars",
)
cte(
    "industry",
    """SELECT s_suppkey AS symbol, s_name AS name, r_name AS l1, n_name AS l2, s_acctbal AS acctbal FROM supplier
    JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""",
)
cte(
    "index_bars",
    """SELECT trade_date, avg(open) AS open, avg(high) AS high, avg(low) AS low, avg(close) AS close,
    CAST(sum(volume) AS BIGINT) AS volume FROM adj GROUP BY trade_date""",
    "adj",
)
cte(
    "trades",
    f"""SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS trade_date, l_orderkey*8+l_linenumber AS seq,
    CASE WHEN l_returnflag='R' THEN 'sell' ELSE 'buy' END AS action, CAST(l_quantity AS BIGINT) AS qty,
    {PX} AS price, l_extendedprice AS value, l_discount AS discount FROM lineitem""",
)
cte(
    "fund",
    """SELECT i.*, acctbal/50 AS pe_ttm, acctbal/100 AS pb, roe, gross_profit_margin, net_profit_margin, revenue_growth, net_profit_growth, top_price, n_trades
    FROM industry i JOIN (SELECT l_suppkey AS symbol,
    CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE)/count(*)*100 AS roe, CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE)/count(*)*100 AS gross_profit_margin,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE)/count(*) AS net_profit_margin,
    count(*) FILTER (l_returnflag='R')/count(*)*100 AS revenue_growth, count(*) FILTER (l_linestatus='O')/count(*)*100 AS net_profit_growth,
    max(l_extendedprice) AS top_price, count(*) AS n_trades FROM lineitem GROUP BY 1) f ON i.symbol=f.symbol""",
    "industry",
)
cte(
    "daily_flow",
    """SELECT symbol, trade_date, CAST(sum(CASE WHEN action='buy' THEN CAST(value AS DECIMAL(18,2)) ELSE -CAST(value AS DECIMAL(18,2)) END) AS DOUBLE) AS net
    FROM trades GROUP BY 1,2""",
    "trades",
)
cte(
    "quality",
    """SELECT symbol, record_date, revenue, n_orders, largest,
    CASE month(record_date) WHEN 3 THEN make_date(year(record_date),4,30) WHEN 6 THEN make_date(year(record_date),8,31)
    WHEN 9 THEN make_date(year(record_date),10,31) ELSE make_date(year(record_date)+1,4,30) END AS disclosure_date FROM (
    SELECT o_custkey AS symbol, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS record_date,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(*) AS n_orders, max(o_totalprice) AS largest
    FROM orders GROUP BY 1,2)""",
)


W_ = "PARTITION BY symbol ORDER BY trade_date"


def lag(c: str, n: int = 1) -> str:
    return f"lag({c},{n}) OVER ({W_})"


def lead(c: str, n: int = 1) -> str:
    return f"lead({c},{n}) OVER ({W_})"


def over(agg: str, n: int | None = None, to: int = 0) -> str:
    """Frame of the last n rows (None = all so far), ending `-to` rows back."""
    lo = "UNBOUNDED PRECEDING" if n is None else f"{n - 1 - to} PRECEDING"
    hi = "CURRENT ROW" if to == 0 else f"{-to} PRECEDING"
    return f"{agg} OVER ({W_} ROWS BETWEEN {lo} AND {hi})"


def full(agg: str, n: int, src: str = "close", mp: int | None = None, to: int = 0) -> str:
    return f"CASE WHEN {over(f'count({src})', n, to)} >= {n if mp is None else mp} THEN {over(agg, n, to)} END"


def rec(x: str, decay: str, gain: str, seed: str, start: int = 0) -> str:
    """Closed form of the linear recurrence (one block; test symbols stay under 1,000 rows)."""
    n = f"(i-{start})"
    return (
        f"CASE WHEN {n}>=0 THEN pow({decay},{n}) * sum(CASE WHEN {n}=0 THEN ({seed}) WHEN {n}>0 THEN ({gain})*({x}) END"
        f" * pow(1e0/({decay}),{n})) OVER ({W_} ROWS UNBOUNDED PRECEDING) END"
    )


def ema(x: str, span: int) -> str:
    return rec(x, f"(1e0-2e0/{span + 1})", f"2e0/{span + 1}", x)


def wilder_seeded(x: str, seed: str, n: int, start: int) -> str:
    return rec(x, f"(1e0-1e0/{n})", f"1e0/{n}", seed, start)


_MA = (5, 10, 20, 30, 60, 90, 120, 200)
cte("i_ma", "SELECT *, " + ", ".join(f"{full('avg(close)', p)} AS ma_{p}" for p in _MA) + " FROM adj", "adj")
cte("i_ema", f"SELECT *, {ema('close', 12)} - {ema('close', 26)} AS dif FROM i_ma", "i_ma")
cte("i_dea", f"SELECT *, {ema('dif', 9)} AS dea FROM i_ema", "i_ema")
cte(
    "i_x",
    f"""SELECT *, 2*(dif-dea) AS macd_hist, coalesce({lag('dea')},0e0) AS pdea,
    coalesce({lag('dif')}, coalesce({lag('dea')},0e0)) AS pdif, {lag('close')} AS pc, {lag('high')} AS ph, {lag('low')} AS pl
    FROM i_dea""",
    "i_dea",
)
cte(
    "i_cross",
    """SELECT *, CASE WHEN dif>dea AND pdif<=pdea THEN 1 WHEN dif<dea AND pdif>=pdea THEN -1 ELSE 0 END AS macd_cross,
    CASE WHEN pc IS NOT NULL THEN greatest(high-low, abs(high-pc), abs(low-pc)) END AS tr,
    CASE WHEN pc IS NOT NULL THEN greatest(close-pc, 0e0) END AS up, CASE WHEN pc IS NOT NULL THEN greatest(pc-close, 0e0) END AS dn,
    CASE WHEN pc IS NOT NULL THEN CASE WHEN high-ph>pl-low AND high-ph>0 THEN high-ph ELSE 0e0 END END AS pdm,
    CASE WHEN pc IS NOT NULL THEN CASE WHEN pl-low>high-ph AND pl-low>0 THEN pl-low ELSE 0e0 END END AS mdm,
    (high+low+close)/3 AS tp FROM i_x""",
    "i_x",
)
cte(
    "i_seed",
    f"""SELECT *, CASE WHEN macd_cross=1 AND dif>0 AND dea>0 THEN 'golden_above_zero' WHEN macd_cross=1 THEN 'golden_below_zero'
    WHEN macd_cross=-1 AND dif<0 AND dea<0 THEN 'dead_below_zero' WHEN macd_cross=-1 THEN 'dead_above_zero'
    WHEN dif>0 THEN 'bull' ELSE 'bear' END AS macd_label,
    {over('avg(tr)', 14)} AS tr14, {over('avg(up)', 14)} AS up14, {over('avg(dn)', 14)} AS dn14,
    {over('sum(tr)', 13)} AS str13, {over('sum(pdm)', 13)} AS sp13, {over('sum(mdm)', 13)} AS sm13,
    {full('avg(tp)', 20, 'tp')} AS tpm, {over('list(tp)', 20)} AS tpl,
    {full('avg(close)', 20)} AS bb_mid, {full('stddev_pop(close)', 20)} AS bb_sd,
    {full('max(high)', 9)} AS hh9, {full('min(low)', 9)} AS ll9 FROM i_cross""",
    "i_cross",
)
_D = "(1e0-1e0/14)"
cte(
    "i_w",
    f"""SELECT *, {wilder_seeded('tr', 'tr14', 14, 14)} AS atr, {wilder_seeded('up', 'up14', 14, 14)} AS au,
    {wilder_seeded('dn', 'dn14', 14, 14)} AS ad, {rec('tr', _D, '1e0', 'str13', 13)} AS s_tr, {rec('pdm', _D, '1e0', 'sp13', 13)} AS s_p,
    {rec('mdm', _D, '1e0', 'sm13', 13)} AS s_m,
    CASE WHEN hh9 IS NOT NULL THEN coalesce(100*(close-ll9)/nullif(hh9-ll9,0),0) END AS fk,
    bb_mid+2*bb_sd AS bb_up, bb_mid-2*bb_sd AS bb_low,
    CASE WHEN tpm IS NOT NULL THEN coalesce((tp-tpm)/nullif(0.015e0*list_sum(list_transform(tpl, lambda q: abs(q-tpm)))/20,0),0) END AS cci
    FROM i_seed""",
    "i_seed",
)
cte(
    "i_dx",
    f"""SELECT *, CASE WHEN au IS NOT NULL THEN coalesce(100*au/nullif(au+ad,0),0) END AS rsi,
    CASE WHEN i>=14 THEN coalesce(100*abs(s_p/nullif(s_tr,0)-s_m/nullif(s_tr,0))/nullif(s_p/nullif(s_tr,0)+s_m/nullif(s_tr,0),0),0) END AS dx,
    {full('avg(fk)', 3, 'fk')} AS slow_k, (bb_up-bb_low)/nullif(close,0) AS bb_width,
    {full('avg(amount)', 20, 'amount', to=-1)} AS amount_ma20, (high-low)/nullif(close,0) AS amplitude FROM i_w""",
    "i_w",
)
cte("i_dxs", f"SELECT *, {over('avg(dx)', 14)} AS dx14, {full('avg(slow_k)', 3, 'slow_k')} AS slow_d FROM i_dx", "i_dx")
cte("ind", f"SELECT *, {wilder_seeded('dx', 'dx14', 14, 27)} AS adx FROM i_dxs", "i_dxs")


def avgrank(v: str, by: str = "") -> str:
    """Average-tie rank of v within `by` (comma list)."""
    p = f"PARTITION BY {by}" if by else ""
    q = f"PARTITION BY {by + ', ' if by else ''}{v}"
    return f"(CASE WHEN {v} IS NOT NULL THEN rank() OVER ({p} ORDER BY {v}) + (count(*) OVER ({q})-1)/2e0 END)"


def pctrank(v: str, by: str = "") -> str:
    p = f"PARTITION BY {by}" if by else ""
    return f"({avgrank(v, by)}/count({v}) OVER ({p}))"


def zsql(v: str, by: str = "") -> str:
    p = f"PARTITION BY {by}" if by else ""
    z = f"(({v}-avg({v}) OVER ({p}))/nullif(stddev_samp({v}) OVER ({p}),0))"
    return f"(CASE WHEN {z} IS NULL THEN 0e0 ELSE greatest(-3e0,least(3e0,{z})) END)"
