"""Queries about sources with varying headers, live allocation and order summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import live as L
from ..operators import portfolio as P
from ..sources import tables
from .panels import EV, PM, intraday, monthly, read
from .registry import query

_LAST = f"{PM}, l AS (SELECT *, row_number() OVER (ORDER BY amount DESC, symbol) AS place FROM pm WHERE trade_date = (SELECT max(trade_date) FROM pm))"


def _last(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = monthly(spark, sf_dir)
    return p.join(F.broadcast(p.agg(F.max("trade_date").alias("trade_date"))), "trade_date")


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS trade_date, CAST(o_custkey % 50 AS VARCHAR) AS symbol FROM orders WHERE o_orderkey % 4 IN (0, 2)")
def universe_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    day = F.when(key % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    chosen = F.when(key % 4 == 0, " Yes ").when(key % 4 == 1, "0").when(key % 4 == 2, "true")
    raw = o.select(day.alias("Rebalance_Date"), F.concat(F.lit(" "), F.col("o_custkey") % 50, F.lit(" ")).alias("stock_ticker"), chosen.alias("is_selected"))
    return tables.universe_by_date(raw)


@query("SELECT CAST(o_orderdate AS DATE) AS trade_date, CAST(arg_max(o_custkey, o_orderkey) AS DOUBLE) AS benchmark_return FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1")
def return_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    value = F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_custkey").cast("string"))
    return tables.return_series(o.select(F.date_format("o_orderdate", "yyyyMMdd").alias("exit_date"), value.alias("return"), "o_orderkey"), "o_orderkey")


@query("""WITH c AS (SELECT l_suppkey, l_linenumber * 100.0 AS lot, count(*) AS n, max(l_orderkey * 10 + l_linenumber) AS place FROM lineitem WHERE l_quantity > 5 GROUP BY 1, 2)
SELECT l_suppkey, CAST(lot AS DOUBLE) AS lot FROM c QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, place DESC) = 1""")
def round_lot_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_quantity") > 5, F.col("l_linenumber") * 100.0).alias("lot"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return L.round_lots(lines, "l_suppkey", "lot", "place")


@query(f"""WITH {EV}, one AS (SELECT symbol, event_id % 3 AS kind, arg_max(price, event_id) AS price FROM ev GROUP BY 1, 2),
c AS (SELECT a.symbol, a.price AS p2, b.price - 50 AS p0, d.price - 50 AS p1 FROM one a LEFT JOIN one b ON a.symbol = b.symbol AND b.kind = 0 LEFT JOIN one d ON a.symbol = d.symbol AND d.kind = 1 WHERE a.kind = 2)
SELECT symbol, round(CASE WHEN p0 > 0 THEN p0 WHEN p1 > 0 THEN p1 ELSE p2 END, 6) AS price, CASE WHEN p0 > 0 THEN 'snapshot' WHEN p1 > 0 THEN '1m_close' ELSE '1d_close' END AS price_source FROM c""")
def latest_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = intraday(spark, sf_dir)
    one = lambda k, less: e.filter(F.col("event_id") % 3 == k).groupBy("symbol").agg((F.max_by("price", "event_id") - less).alias("price"))
    return L.latest_prices(one(2, 0), one(0, 50), one(1, 50)).withColumn("price", F.round("price", 6))


@query(f"""WITH {PM}, q AS (SELECT *, CASE WHEN count(close) OVER w >= 12 THEN quantile_cont(close, 0.8) OVER w END AS h, CASE WHEN count(close) OVER w >= 12 THEN quantile_cont(close, 0.95) OVER w END AS x
  FROM pm WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
l AS (SELECT symbol, trade_date, close, lag(h) OVER s AS st, lag(x) OVER s AS xt, lag(close) OVER s AS before, max(trade_date) OVER () AS as_of FROM q WINDOW s AS (PARTITION BY symbol ORDER BY trade_date))
SELECT symbol, as_of, max(close) FILTER (trade_date = as_of) AS close, round(max(st) FILTER (trade_date = as_of), 6) AS sell_trigger, round(max(xt) FILTER (trade_date = as_of), 6) AS extreme_trigger,
  max(trade_date) FILTER (close >= st AND before < st) AS last_sell_signal_date FROM l GROUP BY 1, 2""")
def sell_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = L.sell_signals(monthly(spark, sf_dir), 12, 0.8, 0.95)
    return made.withColumns({c: F.round(c, 6) for c in ("sell_trigger", "extreme_trigger")})


@query(f"WITH {_LAST} SELECT CAST(capital AS DOUBLE) AS capital, CAST(n AS INTEGER) AS top_n, symbol, CAST(floor(capital / n / (close * 10)) AS BIGINT) AS lots FROM l JOIN (SELECT * FROM (VALUES (1e5), (1e6)) a(capital), (VALUES (3), (5)) b(n)) ON place <= n")
def scenario_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = P.select(_last(spark, sf_dir).withColumn("s", F.col("amount")), 5)
    return L.scenarios(ranked.select("symbol", "place", F.col("close").alias("price")), [1e5, 1e6], [3, 5], 10)


@query(f"WITH {_LAST} SELECT symbol, round(1.0 / count(*) OVER (), 6) AS target_weight FROM l WHERE place <= 8")
def target_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = P.weights(P.select(_last(spark, sf_dir).withColumn("s", F.col("amount")), 8))
    return L.targets(held).withColumn("target_weight", F.round("target_weight", 6))


@query("""WITH o AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_linenumber AS i, CAST(l_quantity AS DOUBLE) AS q FROM lineitem WHERE l_quantity IS NOT NULL),
f AS (SELECT side, i, q, CASE WHEN i = 1 THEN 0 WHEN i <= 3 THEN q / 2 ELSE q END AS f FROM o)
SELECT count(*) AS orders, sum(q) AS requested_notional, sum(f) AS filled_notional, sum(q - f) AS unfilled_notional, round(sum(f) / sum(q), 6) AS fill_ratio,
  round(sum(f) FILTER (side = 'buy') / sum(q) FILTER (side = 'buy'), 6) AS buy_fill_ratio, round(sum(f) FILTER (side = 'sell') / sum(q) FILTER (side = 'sell'), 6) AS sell_fill_ratio,
  sum(q - f) FILTER (side = 'buy') AS unfilled_buy_notional, sum(q - f) FILTER (side = 'sell') AS unfilled_sell_notional,
  count(*) FILTER (side = 'buy' AND i = 1) AS abandoned_buy_orders, count(*) FILTER (side = 'sell' AND i <= 3) AS delayed_sell_orders FROM f""")
def order_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    side, i, q = F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy"), F.col("l_linenumber"), F.col("l_quantity").cast("double")
    filled = F.when(i == 1, 0.0).when(i <= 3, q / 2).otherwise(q)
    status = F.when((side == "buy") & (i == 1), "abandoned_zero_fill").when((side == "sell") & (i <= 3), "delayed_sell").otherwise("done")
    orders = read(spark, sf_dir, "lineitem").filter("l_quantity is not null").select(side.alias("side"), status.alias("status"), q.alias("requested_notional"), filled.alias("filled_notional"), (q - filled).alias("unfilled_notional"))
    made = L.order_summary(orders)
    return made.withColumns({c: F.round(c, 6) for c in ("fill_ratio", "buy_fill_ratio", "sell_fill_ratio")})


# ---- sources and tables

@query("SELECT CAST(s_suppkey AS VARCHAR) AS symbol, s_name AS name, CAST(NULL AS DATE) AS list_date FROM supplier")
def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables.projected(spark, f"{sf_dir}/supplier.parquet", ["s_suppkey", "s_name", "not there"])
    return tables.instruments(raw.select(F.col("s_suppkey").alias("Order_Book_Id"), F.col("s_name").alias("name")))


@query("SELECT CAST(o_orderdate AS DATE) AS trade_date, CAST(o_custkey AS VARCHAR) AS symbol, arg_max(o_totalprice, o_orderkey) AS price FROM orders WHERE o_orderdate IS NOT NULL AND o_custkey IS NOT NULL GROUP BY 1, 2")
def prices_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables.projected(spark, f"{sf_dir}/orders.parquet", ["o_orderdate", "o_custkey", "o_totalprice", "o_orderkey"])
    named = raw.select(F.date_format("o_orderdate", "yyyyMMdd").alias("DATE"), F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("ts_code"), F.col("o_totalprice").alias("price"), "o_orderkey")
    return tables.keyed(named, ["price"], order="o_orderkey")


@query("SELECT trade_date, symbol, max(label) AS label FROM (SELECT CAST(o_orderdate AS DATE) AS trade_date, CAST(o_custkey AS VARCHAR) AS symbol, o_orderpriority AS label FROM orders WHERE o_orderdate IS NOT NULL AND o_custkey IS NOT NULL) GROUP BY 1, 2")
def industry_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("trade_date"), F.col("o_custkey").alias("symbol"), F.col("o_orderpriority").alias("label"))
    return tables.keyed(raw, ["label"])


@query("SELECT n_name AS name, NULL::VARCHAR AS r_name FROM nation WHERE n_name IS NOT NULL UNION ALL SELECT NULL, r_name FROM region")
def many_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tables.many(spark, [f"{sf_dir}/nation.parquet", f"{sf_dir}/region.parquet"], ["n_name", "r_name"])
    return made.select(F.col("n_name").alias("name"), "r_name")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS symbol, lower(o_orderstatus) AS field, year(o_orderdate) || 'q' || quarter(o_orderdate) AS quarter, o_orderpriority AS subject, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderkey AS DOUBLE) END AS amount, CAST(o_orderdate AS DATE) AS info_date FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL AND o_orderstatus IN ('O', 'F') AND o_orderkey % 11 <> 0""")
def details_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    quarter = F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit(" "))
    raw = o.select(F.col("o_custkey").alias("symbol"), F.concat(F.lit(" "), "o_orderstatus").alias("field"), quarter.alias("quarter"), F.when(F.col("o_orderkey") % 11 == 0, "  ").otherwise(F.col("o_orderpriority")).alias("subject"), F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise(F.col("o_orderkey").cast("string")).alias("amount"), F.date_format("o_orderdate", "yyyyMMdd").alias("info_date"), *(F.lit("x").alias(c) for c in ("order_book_id", "fiscal_year", "relationship", "currency", "standard", "if_adjusted")))
    return tables.details(raw, ["O", "F"]).select("symbol", "field", "quarter", "subject", "amount", "info_date")


@query("SELECT CAST(o_orderdate AS DATE) AS trade_date, CAST(o_custkey AS VARCHAR) AS symbol, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS score, CAST(o_orderkey AS DOUBLE) AS weight FROM orders WHERE o_orderdate IS NOT NULL AND o_custkey IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderkey % 5 <> 0")
def scored_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows under other headers, some scores not readable."""
    o = read(spark, sf_dir, "orders")
    raw = o.select(F.date_format("o_orderdate", "yyyyMMdd").alias("Date"), F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" ")).alias("ts_code"), F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("pred"), F.col("o_orderkey").alias("weight"))
    return tables.scored_panel(raw, ["weight", "absent"])


_POS = f"{PM}, ps AS (SELECT trade_date AS entry_date, symbol, round(1.0 / count(*) OVER (PARTITION BY trade_date), 9) AS weight FROM pm WHERE CAST(vol AS BIGINT) % 3 = 0), ds AS (SELECT DISTINCT entry_date FROM ps ORDER BY 1 DESC LIMIT 2)"


def _positions(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    p = monthly(spark, sf_dir).filter(F.col("vol").cast("long") % 3 == 0)
    return tables.position_tables(P.weights(p).select(F.col("trade_date").alias("entry_date"), "symbol", F.round("weight", 9).alias("weight")))


@query(f"WITH {_POS} SELECT entry_date, symbol, weight FROM ps WHERE entry_date = (SELECT max(entry_date) FROM ds)")
def current_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(spark, sf_dir)["current"].select("entry_date", "symbol", "weight")


@query(f"WITH {_POS}, a AS (SELECT symbol, weight FROM ps WHERE entry_date = (SELECT max(entry_date) FROM ds)), b AS (SELECT symbol, weight FROM ps WHERE entry_date = (SELECT min(entry_date) FROM ds)) SELECT symbol, b.weight AS old_value, a.weight AS new_value, CASE WHEN b.weight IS NULL THEN 'added' WHEN a.weight IS NULL THEN 'removed' ELSE 'changed' END AS status FROM a FULL JOIN b USING (symbol) WHERE b.weight IS NULL OR a.weight IS NULL OR abs(a.weight - b.weight) >= 1e-12")
def position_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(spark, sf_dir)["diff"].select("symbol", "old_value", "new_value", "status")


# ---- allocation

@query(f"""WITH RECURSIVE {PM}, ls AS (SELECT symbol, close, vol FROM pm WHERE trade_date = (SELECT max(trade_date) FROM pm)),
al AS (SELECT scenario, capital, symbol, close * 10 AS cost, floor(capital / n / (close * 10)) AS lots, capital / n AS goal, CASE CAST(symbol AS BIGINT) % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS class, vol > 0 AS ok FROM (SELECT *, count(*) OVER (PARTITION BY scenario) AS n FROM ls, (VALUES ('small', 2e6::DOUBLE), ('large', 2e7::DOUBLE)) v(scenario, capital))),
gp AS (SELECT *, goal - lots * cost AS gap FROM al), wn AS (SELECT *, CASE WHEN ok AND cost > 0 AND gap > 1e-9 THEN floor(gap / cost + 1e-12) + CASE WHEN gap - floor(gap / cost + 1e-12) * cost > 1e-9 AND cost < 2 * (gap - floor(gap / cost + 1e-12) * cost) - 1e-9 AND cost - (gap - floor(gap / cost + 1e-12) * cost) <= 5e3 + 1e-9 THEN 1 ELSE 0 END ELSE 0 END AS wanted FROM gp),
od AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY class = 2, class, abs(gap - cost), cost, symbol) AS k FROM wn),
go AS (SELECT scenario, CAST(0 AS BIGINT) AS k, capital - sum(lots * cost) AS cash, CAST(0 AS DOUBLE) AS extra FROM od GROUP BY scenario, capital UNION ALL
SELECT od.scenario, od.k, go.cash - (cost + 5) * least(wanted, floor((go.cash + 1e-9) / (cost + 5))), least(wanted, floor((go.cash + 1e-9) / (cost + 5))) FROM go JOIN od ON od.scenario = go.scenario AND od.k = go.k + 1)
SELECT scenario, symbol, CAST(lots + extra AS BIGINT) AS lots, CAST(extra AS BIGINT) AS extra, round(gap - extra * cost, 4) AS gap, round((SELECT arg_max(cash, k) FROM go g WHERE g.scenario = od.scenario), 4) AS cash_left FROM od JOIN go USING (scenario, k)""")
def secondary_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest date's allocation at two capitals, left-over cash spent lot by lot."""
    last = _last(spark, sf_dir)
    grid = spark.createDataFrame([("small", 2e6), ("large", 2e7)], "scenario string, capital double")
    sized = last.crossJoin(F.broadcast(last.agg(F.count(F.lit(1)).alias("n")))).crossJoin(F.broadcast(grid))  # one row; two rows
    rule = F.when(F.col("symbol").cast("long") % 4 == 0, "HIGH").when(F.col("symbol").cast("long") % 4 == 1, "LOW").otherwise("NEUTRAL")
    goal = F.col("capital") / F.col("n")
    made = sized.select("scenario", "capital", "symbol", F.col("close").alias("price"), F.lit(10.0).alias("round_lot"), F.floor(goal / (F.col("close") * 10)).alias("lots"), goal.alias("target_value"), rule.alias("valuation"), (F.col("vol") > 0).alias("tradable"))
    out = L.secondary_fill(made, L.Filling(steps=None, fee=5.0, most_over=5e3, calm_first=True))
    return out.select("scenario", "symbol", "lots", "extra", F.round("gap", 4).alias("gap"), F.round("cash_left", 4).alias("cash_left"))
