"""Queries about modelling data, execution, exposures, runs and disclosures."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import benchmarks as B
from ..operators import dataset as DS
from ..operators import dates as D
from ..operators import execution as E
from ..operators import joins as J
from ..operators import portfolio as P
from ..operators import research as Q
from ..operators import signals as S
from ..operators import splits as SP
from ..operators import timeseries as TS
from .panels import PM, PW, SC, SUP, W, monthly, read, scored, suppliers, weekly
from .registry import query

R = 6


def _r(df: DataFrame, **digits: int) -> DataFrame:
    return df.select(*(F.round(c, digits.get(c, R)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# ---- modelling data

_SPEC = DS.PanelSpec("l_shipdate", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax", ("l_returnflag",))


@query("SELECT CAST(l_shipdate AS DATE) AS trade_date, CAST(l_suppkey AS VARCHAR) AS symbol, l_extendedprice AS close, l_quantity AS vol, l_tax AS amount, l_returnflag FROM lineitem WHERE l_shipdate IS NOT NULL AND l_suppkey IS NOT NULL")
def canonical_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _SPEC.canonical(read(spark, sf_dir, "lineitem"))


_UNI = "uni AS (SELECT trade_date AS rebalance_date, symbol FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, symbol) AS n FROM pm WHERE month(trade_date) % 3 = 1) WHERE n <= 20)"
_MODEL = f"""{PM}, {_UNI}, sg AS (SELECT trade_date, symbol, close, vol, close / nullif(lag(close, 3) OVER ({W}), 0) - 1 AS s, lead(close) OVER ({W}) / nullif(close, 0) - 1 AS t FROM pm),
m AS (SELECT DISTINCT trade_date, (SELECT max(rebalance_date) FROM uni WHERE rebalance_date <= trade_date) AS rebalance_date FROM sg), u AS (SELECT sg.* FROM sg JOIN m USING (trade_date) JOIN uni USING (rebalance_date, symbol) WHERE s IS NOT NULL AND vol IS NOT NULL),
wz AS (SELECT trade_date, symbol, CASE WHEN t IS NOT NULL THEN greatest(least(t, quantile_cont(t, 0.95) OVER d), quantile_cont(t, 0.05) OVER d) END AS t, coalesce((s - avg(s) OVER d) / nullif(stddev_pop(s) OVER d, 0), 0) AS s, coalesce((vol - avg(vol) OVER d) / nullif(stddev_pop(vol) OVER d, 0), 0) AS vol FROM u WINDOW d AS (PARTITION BY trade_date)),
tr AS (SELECT *, CASE WHEN t IS NOT NULL THEN coalesce((t - avg(t) OVER d) / nullif(stddev_pop(t) OVER d, 0), 0) END AS train_target FROM wz WINDOW d AS (PARTITION BY trade_date)), fu AS (SELECT * FROM tr WHERE t IS NOT NULL),
rb AS (SELECT max(trade_date) AS trade_date FROM fu GROUP BY date_trunc('quarter', trade_date)), sm AS (SELECT fu.* FROM fu JOIN rb USING (trade_date)), ct AS (SELECT trade_date, count(DISTINCT symbol) AS n FROM sm GROUP BY 1)"""
_RECIPE = DS.Recipe(("s", "vol"), "t", 0.05, "zscore", "zscore", "quarter", 8)


def _raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = monthly(spark, sf_dir)
    w = TS.along()
    rows = p.select("trade_date", "symbol", "close", "vol", (F.try_divide("close", F.lag("close", 3).over(w)) - 1).alias("s"), (F.try_divide(F.lead("close").over(w), F.col("close")) - 1).alias("t"))
    top = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("amount"), "symbol"))
    return rows, p.filter("month(trade_date) % 3 = 1").withColumn("n", top).filter("n <= 20").select(F.col("trade_date").alias("rebalance_date"), "symbol")


@query(f"WITH {_MODEL} SELECT trade_date, symbol, round(s, 6) AS s, round(vol, 6) AS vol, round(t, 6) AS t, round(train_target, 6) AS train_target FROM sm JOIN ct USING (trade_date) WHERE n >= 8")
def modeling_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, universe = _raw(spark, sf_dir)
    return _r(DS.modeling_rows(rows, _RECIPE, universe).select("trade_date", "symbol", "s", "vol", "t", "train_target"))


@query(f"WITH {_MODEL} SELECT trade_date, n FROM ct WHERE n < 15")
def dropped_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, universe = _raw(spark, sf_dir)
    recipe = DS.Recipe(_RECIPE.features, "t", 0.05, "zscore", "zscore", "quarter")
    return DS.dropped_dates(DS.modeling_rows(rows, recipe, universe), 15)


@query(f"WITH {PM} SELECT trade_date, symbol, close, amount FROM pm")
def pricing_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = monthly(spark, sf_dir)
    return DS.pricing_frame(p.unionByName(p.filter("vol > 300")), ("close", "amount"), ("vol",))


@query(f"""WITH {PW}, reb AS (SELECT max(trade_date) AS rebalance_date FROM pw GROUP BY date_trunc('quarter', trade_date)),
e AS (SELECT trade_date, symbol, lead(close, 1) OVER ({W}) AS entry FROM pw), nx AS (SELECT *, (SELECT min(rebalance_date) FROM reb WHERE rebalance_date > e.trade_date) AS nr FROM e)
SELECT a.trade_date, a.symbol, round(b.entry / nullif(a.entry, 0) - 1, 6) AS t FROM nx a LEFT JOIN e b ON b.symbol = a.symbol AND b.trade_date = a.nr""")
def label_shifted_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(DS.label_to_rebalance(weekly(spark, sf_dir), "quarter", delay=1).select("trade_date", "symbol", "t"))


@query(f"WITH {PW}, o AS (SELECT * FROM pw WHERE trade_date < '1995-04-01' AND trade_date >= '1995-01-02' AND month(trade_date) < 4) SELECT trade_date, symbol, round(lead(close, 3) OVER ({W}) / nullif(lead(close, 1) OVER ({W}), 0) - 1, 6) AS t FROM o")
def label_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quarter has a single rebalance date, so the fixed horizon counts."""
    p = weekly(spark, sf_dir).filter("trade_date >= date'1995-01-02' and trade_date < date'1995-04-01'")
    return _r(DS.label_to_rebalance(p, "quarter", delay=1, horizon=2).select("trade_date", "symbol", "t"))


@query(f"WITH {PM}, d AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM pm)) SELECT trade_date, i >= n - floor(n * 0.2) AS is_holdout, count(*) AS n FROM pm JOIN d USING (trade_date) GROUP BY 1, 2")
def final_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DS.holdout(monthly(spark, sf_dir), 0.2).groupBy("trade_date", "is_holdout").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PM}, l AS (SELECT max(trade_date) AS last FROM pm) SELECT trade_date, count(*) AS n FROM pm, l WHERE trade_date > last - INTERVAL 30 MONTH GROUP BY 1")
def train_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DS.train_window(monthly(spark, sf_dir), years=2.5).groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PM} SELECT symbol IN ('1', '2', '3') AS benchmark, count(*) AS n, count(DISTINCT symbol) AS symbols FROM pm GROUP BY 1")
def benchmark_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest, mine = DS.without_benchmark(monthly(spark, sf_dir), ["1", "2", "3"])
    both = rest.withColumn("benchmark", F.lit(False)).unionByName(mine.withColumn("benchmark", F.lit(True)))
    return both.groupBy("benchmark").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("symbol").alias("symbols"))


@query(f"WITH {PM} SELECT trade_date, symbol, coalesce(vol > 0 AND amount > 0 AND vol >= 300 AND amount >= 100000 AND NOT CAST(vol AS BIGINT) % 7 = 0, FALSE) AS is_tradable FROM pm")
def tradable_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = monthly(spark, sf_dir).withColumn("halted", F.col("vol").cast("long") % 7 == 0)
    return DS.tradable(p, 100_000, 300, "halted").select("trade_date", "symbol", "is_tradable")


_INST = "ins AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN DATE '1997-03-01' END AS list_date FROM supplier)"


def _instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.when(F.col("s_suppkey") % 3 == 0, F.lit("1997-03-01").cast("date"))
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("s_name").alias("name"), listed.alias("list_date"))


@query(f"WITH {PM}, {_INST} SELECT trade_date, symbol FROM pm WHERE symbol NOT IN (SELECT symbol FROM ins WHERE regexp_matches(lower(name), '(1|7)$'))")
def name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DS.without_names(monthly(spark, sf_dir), _instruments(spark, sf_dir), "(1|7)$").select("trade_date", "symbol")


@query(f"WITH {PM}, {_INST}, l AS (SELECT pm.*, coalesce(list_date, min(trade_date) OVER (PARTITION BY symbol)) AS listed FROM pm LEFT JOIN ins USING (symbol)) SELECT trade_date, symbol FROM l WHERE trade_date >= listed + 365")
def age_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DS.of_age(monthly(spark, sf_dir), 365, _instruments(spark, sf_dir)).select("trade_date", "symbol")


@query(f"""WITH {PM}, j AS (SELECT a.trade_date, a.symbol, b.amount AS v, row_number() OVER (PARTITION BY a.symbol ORDER BY a.trade_date) AS n FROM pm a LEFT JOIN (SELECT * FROM pm WHERE month(trade_date) % 3 = 0) b USING (trade_date, symbol)),
f AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS f, last_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER w AS fn FROM j WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)) SELECT trade_date, symbol, CASE WHEN n - fn <= 1 THEN f END AS revenue FROM f""")
def merge_and_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = monthly(spark, sf_dir)
    right = p.filter("month(trade_date) % 3 = 0").select("trade_date", "symbol", F.col("amount").alias("revenue"))
    return DS.filled_after(p, right, ["revenue"], 1).select("trade_date", "symbol", "revenue")


_PLAN = f"{PW}, cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS idx FROM (SELECT DISTINCT trade_date FROM pw)), rb AS (SELECT trade_date AS rebalance_date, idx FROM cal JOIN (SELECT max(trade_date) AS trade_date FROM pw GROUP BY date_trunc('month', trade_date)) USING (trade_date))"


@query(f"WITH {_PLAN}, p AS (SELECT rebalance_date, idx + 1 AS entry_idx, lead(idx) OVER (ORDER BY idx) + 1 AS exit_idx FROM rb) SELECT rebalance_date, a.trade_date AS entry_date, b.trade_date AS exit_date, entry_idx, exit_idx FROM p JOIN cal a ON a.idx = entry_idx JOIN cal b ON b.idx = exit_idx")
def period_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = weekly(spark, sf_dir)
    return DS.period_plan(D.rebalance_dates(p, "month"), D.calendar(p), 1).select("rebalance_date", "entry_date", "exit_date", F.col("entry_idx").cast("long").alias("entry_idx"), F.col("exit_idx").cast("long").alias("exit_idx"))


@query(f"""WITH RECURSIVE {_PLAN}, p AS (SELECT rebalance_date, idx AS entry_idx, idx + 6 AS exit_idx, row_number() OVER (ORDER BY idx) AS n FROM rb WHERE idx + 6 <= (SELECT max(idx) FROM cal)),
k AS (SELECT n, exit_idx AS until, TRUE AS kept FROM p WHERE n = 1 UNION ALL SELECT p.n, CASE WHEN p.entry_idx >= k.until THEN p.exit_idx ELSE k.until END, p.entry_idx >= k.until FROM k JOIN p ON p.n = k.n + 1)
SELECT rebalance_date, a.trade_date AS entry_date, b.trade_date AS exit_date FROM p JOIN k USING (n) JOIN cal a ON a.idx = entry_idx JOIN cal b ON b.idx = exit_idx WHERE kept""")
def period_plan_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = weekly(spark, sf_dir)
    return DS.period_plan(D.rebalance_dates(p, "month"), D.calendar(p), 0, 6).select("rebalance_date", "entry_date", "exit_date")


@query(f"""WITH {PM}, {SC}, x AS (SELECT max(trade_date) AS last FROM sc), d AS (SELECT trade_date, count(*) AS n, greatest(pow(0.999, date_diff('day', trade_date, any_value(last))), 0.3) AS raw FROM sc, x GROUP BY 1) SELECT trade_date, round(raw / avg(raw) OVER () / n, 8) AS weight FROM d""")
def sample_weight_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = SP.decay_weights(scored(spark, sf_dir), floor=0.3, rate=0.001)
    return made.groupBy("trade_date").agg(F.round(F.max("weight"), 8).alias("weight"))


_BUF = """rk AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY s DESC, symbol) AS place, count(*) OVER (PARTITION BY trade_date) AS n FROM sc),
nm AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i, names FROM (SELECT trade_date, list(symbol ORDER BY place) AS names FROM rk WHERE place <= 8 AND n >= 5 GROUP BY 1)),
f AS (SELECT i, trade_date, names[:5] AS held FROM nm WHERE i = 1 UNION ALL SELECT i, trade_date, list_concat(pool, list_filter(names, lambda z: NOT list_contains(pool, z)))[:5] FROM (SELECT i, trade_date, names, list_concat(kept, list_filter(names[:4], lambda z: NOT list_contains(kept, z))) AS pool FROM (
SELECT nm.i, nm.trade_date, nm.names, list_filter(nm.names, lambda z: list_contains(f.held, z)) AS kept FROM f JOIN nm ON nm.i = f.i + 1)))"""


@query(f"WITH RECURSIVE {PM}, {SC}, {_BUF}, l AS (SELECT trade_date, held, lag(held) OVER (ORDER BY trade_date) AS prev FROM f) SELECT trade_date, round(1 - len(list_intersect(held, prev)) / 5.0, 6) AS turnover FROM l WHERE prev IS NOT NULL")
def turnover_buffered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(S.turnover(scored(spark, sf_dir), 5, exit_=3, entry=1))


_HELD = f"{PM}, {SC}, held AS (SELECT trade_date AS entry_date, symbol, place FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY s DESC, symbol) AS place FROM sc) WHERE place <= 4)"


@query(f"WITH {_HELD}, d AS (SELECT entry_date, lead(entry_date) OVER (ORDER BY entry_date) AS nx FROM (SELECT DISTINCT entry_date FROM held)) SELECT strftime(entry_date, '%Y%m%d') AS entry_date, symbol, strftime(nx, '%Y%m%d') AS next_entry_date, strftime(entry_date, '%Y%m%d') || ' -> ' || coalesce(strftime(nx, '%Y%m%d'), '') AS holding_window FROM held JOIN d USING (entry_date)")
def holding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = P.select(scored(spark, sf_dir), 4).select(F.col("trade_date").alias("entry_date"), "symbol")
    return DS.holding_windows(held)


_HOLE = f"{PW}, y AS (SELECT *, CASE WHEN CAST(vol AS BIGINT) % 3 <> 0 THEN close END AS hole, CASE WHEN CAST(vol AS BIGINT) % 5 <> 0 THEN amount END AS gap FROM pw)"


def _holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly(spark, sf_dir).withColumns({"hole": F.when(F.col("vol").cast("long") % 3 != 0, F.col("close")), "gap": F.when(F.col("vol").cast("long") % 5 != 0, F.col("amount"))})


@query(f"""WITH {_HOLE}, a AS (SELECT count(*) AS n, count(CASE WHEN hole IS NOT NULL AND gap IS NOT NULL AND vol IS NOT NULL THEN 1 END) AS complete_rows, count(DISTINCT CASE WHEN hole IS NOT NULL AND gap IS NOT NULL AND vol IS NOT NULL THEN trade_date END) AS complete_dates FROM y),
f AS (SELECT 'hole' AS feature, count(*) - count(hole) AS missing, count(DISTINCT CASE WHEN hole IS NOT NULL THEN trade_date END) AS dates FROM y UNION ALL SELECT 'gap', count(*) - count(gap), count(DISTINCT CASE WHEN gap IS NOT NULL THEN trade_date END) FROM y UNION ALL SELECT 'vol', count(*) - count(vol), count(DISTINCT CASE WHEN vol IS NOT NULL THEN trade_date END) FROM y)
SELECT feature, missing, dates, complete_rows, complete_dates, CAST(row_number() OVER (ORDER BY missing DESC, dates, feature DESC) AS INTEGER) AS place, round(100.0 * missing / n, 6) AS missing_pct FROM f, a QUALIFY place <= 2""")
def feature_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(DS.availability(_holes(spark, sf_dir), ["hole", "gap", "vol"], worst=2))


@query(f"""WITH {PM}, {PW}, fund AS (SELECT trade_date, symbol, amount AS revenue FROM pm WHERE month(trade_date) % 6 = 0), a AS (SELECT pw.trade_date, revenue, date_diff('day', fund.trade_date, pw.trade_date) AS age FROM pw ASOF LEFT JOIN fund ON pw.symbol = fund.symbol AND pw.trade_date >= fund.trade_date)
SELECT trade_date, count(*) AS n, round(100.0 * count(revenue) / count(*), 6) AS known_pct, round(avg(age), 6) AS age_mean, round(quantile_cont(age, 0.5), 6) AS age_median, round(quantile_cont(age, 0.9), 6) AS age_p90, CAST(max(age) AS DOUBLE) AS age_max FROM a GROUP BY 1""")
def valuation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fund = monthly(spark, sf_dir).filter("month(trade_date) % 6 = 0").select("trade_date", "symbol", F.col("amount").alias("revenue"))
    made = J.asof(weekly(spark, sf_dir), fund, ["symbol"], "trade_date", ["revenue"], "age")
    return _r(DS.coverage_by_date(made, "revenue", "age"))


_YEARS = "PARTITION BY symbol ORDER BY year(trade_date) * 372 + month(trade_date) * 31 + day(trade_date) RANGE BETWEEN 743 PRECEDING AND CURRENT ROW"


@query(f"""WITH {PM}, g AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS g FROM pm) SELECT trade_date, symbol, round(CASE WHEN count(g) OVER w >= 6 THEN avg(g) OVER w END, 6) AS g_mean, round(CASE WHEN count(g) OVER w >= 6 THEN stddev_samp(g) OVER w END, 6) AS g_std,
round(CASE WHEN count(g) OVER w >= 6 THEN quantile_cont(g, 0.5) OVER w END, 6) AS g_median, round(CASE WHEN count(g) OVER w >= 6 THEN avg(CASE WHEN g IS NULL THEN NULL WHEN g > 0 THEN 1.0 ELSE 0 END) OVER w END, 6) AS g_positive FROM g WINDOW w AS ({_YEARS})""")
def trailing_calendar_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = TS.with_return(monthly(spark, sf_dir), name="g")
    stat = lambda s: TS.calendar_stat("g", 2, s, 6)
    return _r(p.select("trade_date", "symbol", stat("mean").alias("g_mean"), stat("std").alias("g_std"), stat("median").alias("g_median"), stat("positive_ratio").alias("g_positive")))


@query(f"""WITH {PM}, b AS (SELECT *, CAST(trade_date - INTERVAL 36 MONTH AS DATE) AS was FROM pm) SELECT b.trade_date, b.symbol, round(CASE WHEN o.close > 0 AND b.close > 0 THEN pow(b.close / o.close, 1.0 / 3) - 1 END, 6) AS cagr FROM b ASOF LEFT JOIN pm o ON b.symbol = o.symbol AND b.was >= o.trade_date""")
def calendar_cagr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(TS.calendar_cagr(monthly(spark, sf_dir), "close", 3).select("trade_date", "symbol", "cagr"))


# ---- industries and mappings

_LBL = f"{PM}, {SUP}, lb AS (SELECT trade_date, symbol, CASE WHEN (month(trade_date) + CAST(symbol AS BIGINT)) % 4 = 0 THEN industry END AS label FROM pm LEFT JOIN sup USING (symbol))"


@query(f"""WITH {_LBL}, k AS (SELECT * FROM lb WHERE label IS NOT NULL) SELECT lb.trade_date, lb.symbol, coalesce(lb.label, k.label, 'unknown') AS label FROM lb ASOF LEFT JOIN k ON lb.symbol = k.symbol AND lb.trade_date >= k.trade_date""")
def industry_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    sparse = monthly(spark, sf_dir).join(suppliers(spark, sf_dir), "symbol", "left").select("trade_date", "symbol", F.when((F.month("trade_date") + F.col("symbol").cast("long")) % 4 == 0, F.col("industry")).alias("label"))
    return J.labels_asof(sparse, sparse, "label", "unknown")


@query(f"WITH {PM}, {SUP} SELECT trade_date, symbol FROM pm LEFT JOIN sup USING (symbol) WHERE industry IS NULL OR industry NOT IN ('CHINA', 'FRANCE', 'NATION_3', 'NATION_7')")
def industry_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.by_label(monthly(spark, sf_dir), suppliers(spark, sf_dir), "industry", ["CHINA", "FRANCE", "NATION_3", "NATION_7"]).select("trade_date", "symbol")


@query(f"WITH {SUP} SELECT symbol FROM sup WHERE industry IN (SELECT industry FROM sup WHERE symbol IN ('1', '2'))")
def industry_universe_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = suppliers(spark, sf_dir)
    return J.with_label_of(s.select("symbol"), s, "industry", s.filter("symbol in ('1', '2')"))


_PROBE = """pb AS (SELECT CAST(o_custkey AS VARCHAR) AS symbol, lower(trim(o_orderpriority)) AS subject, o_orderstatus AS field, CAST(year(o_orderdate) AS VARCHAR) || 'q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter, CAST(o_orderdate AS DATE) AS info_date, o_totalprice AS amount FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL)"""


def _probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").filter("o_custkey is not null and o_orderdate is not null")
    quarter = F.concat(F.year("o_orderdate").cast("string"), F.lit("q"), F.quarter("o_orderdate").cast("string"))
    return o.select(F.col("o_custkey").cast("string").alias("symbol"), F.lower(F.trim("o_orderpriority")).alias("subject"), F.col("o_orderstatus").alias("field"), quarter.alias("quarter"), F.col("o_orderdate").cast("date").alias("info_date"), F.col("o_totalprice").alias("amount"))


@query(f"WITH {_PROBE} SELECT field, subject, count(*) AS rows, count(DISTINCT symbol) AS symbols FROM pb GROUP BY 1, 2")
def subject_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.subject_frequency(_probe(spark, sf_dir), ["field", "subject"])


_RULES = "mp AS (SELECT * FROM (VALUES ('O', '1-urgent', 'fast'), ('O', '2-high', 'fast'), ('F', '5-low', 'slow')) v(field, subject, normal))"


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("O", "1-urgent", "fast"), ("O", "2-high", "fast"), ("F", "5-low", "slow")], "field string, subject string, normal string")
    return J.mapped(_probe(spark, sf_dir), F.broadcast(rules), ["field", "subject"], "subject", "normal")  # a row for each rule


@query(f"WITH {_PROBE}, {_RULES} SELECT field, coalesce(normal, subject) AS normal, count(*) AS n FROM pb LEFT JOIN mp USING (field, subject) GROUP BY 1, 2")
def mapping_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).groupBy("field", "normal").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PROBE}, {_RULES}, m AS (SELECT field, subject, coalesce(normal, subject) AS normal FROM pb LEFT JOIN mp USING (field, subject)) SELECT field, count(DISTINCT subject) AS raw, count(DISTINCT normal) AS normal, count(DISTINCT subject) - count(DISTINCT normal) AS merged FROM m GROUP BY 1")
def normalization_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.normalization_gain(_mapped(spark, sf_dir), "field", "subject", "normal")


@query(f"WITH {_PROBE}, p AS (SELECT symbol, count(*) AS rows, count(DISTINCT field) AS fields, min(quarter) AS first_quarter, max(quarter) AS last_quarter FROM pb GROUP BY 1) SELECT c.symbol, coalesce(rows, 0) AS rows, coalesce(fields, 0) AS fields, first_quarter, last_quarter FROM (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS symbol FROM customer) c LEFT JOIN p USING (symbol)")
def probe_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.probe_coverage(_probe(spark, sf_dir), read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("symbol")))


@query(f"WITH {_PROBE} SELECT symbol, field, subject, quarter, count(*) AS n, min(info_date) AS first_date, max(info_date) AS last_date, count(DISTINCT amount) AS amounts FROM pb GROUP BY 1, 2, 3, 4 HAVING count(*) > 1")
def duplicate_disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.disclosures(_probe(spark, sf_dir), ["symbol", "field", "subject", "quarter"], "info_date", "amount")


@query(f"WITH {_PROBE}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol, field, subject, quarter ORDER BY info_date DESC, amount DESC) AS n FROM pb) SELECT symbol, field, subject, quarter, info_date, amount FROM k WHERE n = 1")
def financial_details_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.keep_last(_probe(spark, sf_dir), ["symbol", "field", "subject", "quarter"], ["info_date", "amount"])


@query(f"WITH {_PROBE} SELECT DISTINCT field, subject FROM pb WHERE quarter >= '1998q1' AND (field, subject) NOT IN (SELECT field, subject FROM pb WHERE quarter < '1995q2' AND subject <> '3-medium')")
def new_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    pb = _probe(spark, sf_dir)
    return pb.filter("quarter >= '1998q1'").select("field", "subject").distinct().join(pb.filter("quarter < '1995q2' and subject <> '3-medium'").select("field", "subject"), ["field", "subject"], "left_anti")


@query(f"""WITH {_PROBE}, {_RULES}, m AS (SELECT pb.*, coalesce(normal, subject) AS nm FROM pb LEFT JOIN mp USING (field, subject) WHERE quarter >= '1996q1'), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, field, nm, quarter ORDER BY info_date DESC, amount DESC) AS n FROM m),
b AS (SELECT DISTINCT field, coalesce(normal, subject) AS nm FROM pb LEFT JOIN mp USING (field, subject) WHERE quarter < '1996q1' AND subject <> '3-medium')
SELECT k.field, k.nm AS normal, count(*) AS rows, count(CASE WHEN n = 1 THEN 1 END) AS latest_rows, count(CASE WHEN n > 1 THEN 1 END) AS repeats, count(DISTINCT symbol) AS symbols, count(DISTINCT subject) AS raw_subjects, min(quarter) AS first_quarter, max(quarter) AS last_quarter, round(sum(CASE WHEN n = 1 THEN amount END), 2) AS latest_amount, any_value(b.nm) IS NULL AS is_new
FROM k LEFT JOIN b ON b.field = k.field AND b.nm = k.nm GROUP BY 1, 2""")
def details_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pb = _probe(spark, sf_dir)
    rules = spark.createDataFrame([("O", "1-urgent", "fast"), ("O", "2-high", "fast"), ("F", "5-low", "slow")], "field string, subject string, normal string")
    made = Q.details_report(pb.filter("quarter >= '1996q1'"), rules, pb.filter("quarter < '1996q1' and subject <> '3-medium'"))
    return made.withColumn("latest_amount", F.round("latest_amount", 2))


# ---- exposures and benchmarks

_ST = f"""{PM}, {SC}, {SUP}, un AS (SELECT trade_date, symbol, cap, s, ln(amount) AS size, -ln(close) AS value, amount / nullif(vol, 0) - close AS quality, s AS momentum, -abs(s) AS low_vol, vol AS beta FROM sc LEFT JOIN sup USING (symbol)),
lg AS (SELECT trade_date, symbol, cap, factor, x FROM un UNPIVOT (x FOR factor IN (size, value, quality, momentum, low_vol, beta))),
zz AS (SELECT *, (x - avg(x) OVER d) / nullif(stddev_pop(x) OVER d, 0) AS z FROM lg WINDOW d AS (PARTITION BY trade_date, factor)), zk AS (SELECT *, CASE WHEN cap > 0 THEN cap END AS pc FROM zz WHERE z IS NOT NULL),
pl AS (SELECT trade_date, symbol, 1.0 / count(*) OVER (PARTITION BY trade_date) AS w FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY s DESC, symbol) AS p FROM sc) WHERE p <= 4),
ps AS (SELECT trade_date, symbol, -1.0 / count(*) OVER (PARTITION BY trade_date) AS w FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY s, symbol) AS p FROM sc) WHERE p <= 2),
hd AS (SELECT trade_date, symbol, sum(w) AS w FROM (SELECT * FROM pl UNION ALL SELECT * FROM ps) GROUP BY 1, 2), tt AS (SELECT trade_date, sum(abs(w)) AS total, count(*) AS n_holdings FROM hd GROUP BY 1),
sx AS (SELECT trade_date, factor, count(*) AS n_universe, sum(CASE WHEN w > 0 THEN w * z END) / nullif(sum(CASE WHEN w > 0 THEN w END), 0) AS portfolio_long, sum(CASE WHEN w < 0 THEN w * z END) / nullif(sum(CASE WHEN w < 0 THEN w END), 0) AS portfolio_short, sum(w * z) AS portfolio_net,
sum(abs(w) * z) / nullif(sum(abs(w)), 0) AS portfolio_gross, avg(z) AS ue, sum(pc * z) / nullif(sum(pc), 0) AS uc, sum(abs(w)) AS covered FROM zk LEFT JOIN hd USING (trade_date, symbol) GROUP BY 1, 2)"""


def _style_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sc = scored(spark, sf_dir)
    un = sc.join(suppliers(spark, sf_dir), "symbol", "left").select("trade_date", "symbol", "cap", X.compose(["amount"], [("market_cap", "log"), ("amount", "log")]).alias("size"), X.compose(["close"], [("close", "neg_log")]).alias("value"), (X.safe_div("amount", "vol") - F.col("close")).alias("quality"), F.col("s").alias("momentum"), (-F.abs("s")).alias("low_vol"), F.col("vol").alias("beta"))
    leg = lambda k, up, sign: P.weights(P.select(sc, k, ascending=up)).select("trade_date", "symbol", (sign * F.col("weight")).alias("weight"))
    return un, leg(4, False, 1).unionByName(leg(2, True, -1))


@query(f"""WITH {_ST} SELECT trade_date, factor, n_universe, n_holdings, round(coalesce(covered / nullif(total, 0), 0), 6) AS weight_coverage, round(portfolio_long, 5) AS portfolio_long, round(portfolio_short, 5) AS portfolio_short, round(portfolio_net, 5) AS portfolio_net, round(portfolio_gross, 5) AS portfolio_gross,
round(uc, 5) AS universe_cap_weight, round(portfolio_net - uc, 5) AS active_net_vs_cap, round(ue, 5) + 0.0 AS universe_equal, round(portfolio_net - ue, 5) AS active_net_vs_equal FROM sx JOIN tt USING (trade_date)""")
def style_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    un, held = _style_inputs(spark, sf_dir)
    five = ("portfolio_long", "portfolio_short", "portfolio_net", "portfolio_gross", "universe_cap_weight", "active_net_vs_cap", "universe_equal", "active_net_vs_equal")
    made = _r(Q.styles(held, un), **dict.fromkeys(five, 5))
    return made.withColumn("universe_equal", F.col("universe_equal") + 0.0)  # no negative zero


@query(f"""WITH {_ST}, {"hp AS (SELECT trade_date, coalesce(industry, 'unknown') AS industry, sum(w) AS portfolio FROM hd LEFT JOIN sup USING (symbol) GROUP BY 1, 2)"},
bm AS (SELECT trade_date, coalesce(industry, 'unknown') AS industry, sum(wt) AS benchmark FROM (SELECT trade_date, symbol, industry, 1.0 / count(*) OVER (PARTITION BY trade_date) AS wt FROM sc LEFT JOIN sup USING (symbol)) GROUP BY 1, 2),
ia AS (SELECT trade_date, industry, coalesce(portfolio, 0) - coalesce(benchmark, 0) AS active, coalesce(portfolio, 0) AS portfolio FROM hp FULL JOIN bm USING (trade_date, industry)), ik AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY abs(active) DESC, industry) AS k FROM (SELECT trade_date, industry, round(active, 9) AS active, portfolio FROM ia)),
it AS (SELECT trade_date, max(CASE WHEN k = 1 THEN industry END) AS n1, max(CASE WHEN k = 1 THEN active END) AS a1, max(CASE WHEN k = 2 THEN industry END) AS n2, max(CASE WHEN k = 2 THEN active END) AS a2 FROM ik GROUP BY 1)
SELECT trade_date, round(max(CASE WHEN factor = 'size' THEN portfolio_net - uc END), 5) AS size_active_net_vs_cap, round(max(CASE WHEN factor = 'beta' THEN portfolio_net - uc END), 5) AS beta_active_net_vs_cap, any_value(n1) AS industry_top_1_name, round(any_value(a1), 6) AS industry_top_1_active, any_value(n2) AS industry_top_2_name, round(any_value(a2), 6) AS industry_top_2_active FROM sx JOIN it USING (trade_date) GROUP BY 1""")
def active_summary_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    un, held = _style_inputs(spark, sf_dir)
    sup = suppliers(spark, sf_dir).select("symbol", "industry")
    equal = un.select("trade_date", "symbol", (1 / F.count(F.lit(1)).over(Window.partitionBy("trade_date"))).alias("weight")).join(sup, "symbol", "left")
    industry = B.industry_exposure(held.join(sup, "symbol", "left"), equal).withColumn("active", F.round("active", 9))
    made = Q.active_summary(Q.styles(held, un), industry, 2)
    return _r(made.select("trade_date", "size_active_net_vs_cap", "beta_active_net_vs_cap", "industry_top_1_name", "industry_top_1_active", "industry_top_2_name", "industry_top_2_active"), size_active_net_vs_cap=5, beta_active_net_vs_cap=5)


_PB = f"""{PW}, {PM}, ms AS (SELECT trade_date AS entry_date, lead(trade_date) OVER (ORDER BY trade_date) AS exit_date FROM (SELECT max(trade_date) AS trade_date FROM pw GROUP BY date_trunc('month', trade_date))), sp AS (SELECT * FROM ms WHERE exit_date IS NOT NULL),
un AS (SELECT trade_date AS rebalance_date, symbol FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, symbol) AS n FROM pm WHERE month(trade_date) % 3 = 1) WHERE n <= 10),
mb AS (SELECT entry_date, exit_date, symbol FROM (SELECT sp.*, (SELECT max(rebalance_date) FROM un WHERE rebalance_date <= entry_date) AS rebalance_date FROM sp) JOIN un USING (rebalance_date)),
ca AS (SELECT mb.entry_date, exit_date, mb.symbol, c.amount AS cap FROM mb ASOF LEFT JOIN pm c ON mb.symbol = c.symbol AND mb.entry_date >= c.trade_date),
pr AS (SELECT ca.*, b.close / nullif(a.close, 0) - 1 AS r FROM ca LEFT JOIN pw a ON a.symbol = ca.symbol AND a.trade_date = entry_date LEFT JOIN pw b ON b.symbol = ca.symbol AND b.trade_date = exit_date),
ok AS (SELECT *, r IS NOT NULL AND cap > 0 AS good FROM pr), wt AS (SELECT *, CASE WHEN good THEN cap / sum(CASE WHEN good THEN cap END) OVER (PARTITION BY entry_date) END AS weight FROM ok), rk AS (SELECT *, row_number() OVER (PARTITION BY entry_date ORDER BY weight DESC NULLS LAST, symbol) AS k FROM wt)"""


@query(f"WITH {_PB} SELECT entry_date, exit_date, count(*) AS members, count(CASE WHEN good THEN 1 END) AS used, round(100.0 * count(CASE WHEN good THEN 1 END) / count(*), 6) AS coverage_pct, round(sum(weight * r), 6) AS r, round(max(weight), 6) AS top1, round(sum(CASE WHEN k <= 5 THEN weight END), 6) AS top5, round(sum(weight * weight), 6) AS hhi, round(1 / nullif(sum(weight * weight), 0), 4) AS effective_n FROM rk GROUP BY 1, 2")
def period_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    pw, pm = weekly(spark, sf_dir), monthly(spark, sf_dir)
    ends = pw.groupBy(F.trunc("trade_date", "MM")).agg(F.max("trade_date").alias("trade_date"))
    spans = P.periods(ends.select("trade_date")).withColumnRenamed("trade_date", "entry_date")
    top = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("amount"), "symbol"))
    universe = pm.filter("month(trade_date) % 3 = 1").withColumn("n", top).filter("n <= 10").select(F.col("trade_date").alias("rebalance_date"), "symbol")
    return _r(B.period_series(spans, universe, pw, pm.select("trade_date", "symbol", F.col("amount").alias("cap"))), effective_n=4)


# ---- execution

CAPITALS = {"small": 1e5, "large": 1e6}
_EX = f"""{PM}, {SC}, tg AS (SELECT trade_date, symbol, 1.0 / count(*) OVER (PARTITION BY trade_date) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY s DESC, symbol) AS k FROM sc) WHERE k <= 4),
cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS d FROM (SELECT DISTINCT trade_date FROM pm)), rd AS (SELECT trade_date, d, row_number() OVER (ORDER BY trade_date) AS i, lead(d) OVER (ORDER BY trade_date) AS nxt FROM (SELECT DISTINCT trade_date FROM tg) JOIN cal USING (trade_date)),
mv AS (SELECT i, symbol, sum(w) AS delta FROM (SELECT i, symbol, weight AS w FROM tg JOIN rd USING (trade_date) UNION ALL SELECT i + 1, symbol, -weight FROM tg JOIN rd USING (trade_date)) GROUP BY 1, 2 HAVING abs(sum(w)) > 1e-12),
od AS (SELECT trade_date AS rebalance_date, symbol, CASE WHEN delta < 0 THEN 'sell' ELSE 'buy' END AS side, abs(delta) AS requested, d AS lo, CASE WHEN delta < 0 THEN greatest(d, coalesce(nxt - 1, (SELECT max(d) FROM cal))) ELSE least(d + 1, (SELECT max(d) FROM cal)) END AS hi FROM mv JOIN rd USING (i)),
pg AS (SELECT scenario, capital, rebalance_date, od.symbol, side, requested, cal.trade_date, d - lo + 1 AS day_number, coalesce(0.05 * amount, 0) / capital AS capacity FROM od JOIN cal ON d BETWEEN lo AND hi CROSS JOIN (VALUES ('small', 1e5::DOUBLE), ('large', 1e6::DOUBLE)) v(scenario, capital) LEFT JOIN pm ON pm.symbol = od.symbol AND pm.trade_date = cal.trade_date),
dn AS (SELECT *, least(sum(capacity) OVER o, requested) AS done, least(coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), requested) AS prev FROM pg WINDOW o AS (PARTITION BY scenario, rebalance_date, symbol ORDER BY trade_date)),
cl AS (SELECT scenario, capital, rebalance_date, symbol, side, max(requested) AS requested, sum(done - prev) AS filled, count(CASE WHEN done - prev > 1e-12 THEN 1 END) AS fill_days, greatest(max(requested) - sum(done - prev), 0) AS unfilled FROM dn GROUP BY ALL),
st AS (SELECT *, CASE WHEN unfilled <= 1e-12 THEN 'filled' WHEN side = 'sell' THEN 'delayed_sell' WHEN filled > 1e-12 THEN 'cancelled_buy_deadline' ELSE 'abandoned_zero_fill' END AS status FROM cl)"""


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = monthly(spark, sf_dir)
    held = P.weights(P.select(scored(spark, sf_dir), 4)).select(F.col("trade_date").alias("rebalance_date"), F.col("trade_date").alias("entry_date"), "symbol", "weight")
    return E.progress(E.orders(held, p, buy_days=2), p.select("trade_date", "symbol", (0.05 * F.col("amount")).alias("room")), CAPITALS)


@query(f"WITH {_EX} SELECT scenario, rebalance_date, symbol, side, round(requested, 6) AS requested, round(filled, 6) AS filled, fill_days, round(unfilled, 6) AS unfilled, status FROM st")
def execution_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(E.closed(_progress(spark, sf_dir)).drop("capital"))


@query(f"WITH {_EX} SELECT scenario, rebalance_date, symbol, side, trade_date, day_number, round(capacity, 6) AS capacity, round(done - prev, 6) AS fill_weight, round(requested - done, 6) AS remaining FROM dn WHERE done - prev > 1e-12")
def execution_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(E.fills(_progress(spark, sf_dir)).drop("capital", "requested"))


@query(f"WITH {_EX} SELECT scenario, count(*) AS orders, " + ", ".join(f"round(coalesce(sum(CASE WHEN side = '{x}' THEN {c} * capital END), 0), 2) AS {c}_{x}_notional" for x in ("buy", "sell") for c in ("requested", "filled", "unfilled")) + ", " + ", ".join(f"count(CASE WHEN status = '{x}' THEN 1 END) AS {x}" for x in E.STATUSES) + " FROM st GROUP BY 1")
def execution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(E.summarized(E.closed(_progress(spark, sf_dir))), **{f"{c}_{s}_notional": 2 for s in ("buy", "sell") for c in ("requested", "filled", "unfilled")})


# ---- runs

_RUN = f"""{PM}, {SC}, rn AS (SELECT symbol AS run, count(*) AS periods, avg(t) / nullif(stddev_samp(t), 0) AS sharpe, skewness(t) AS skew, kurtosis(t) AS kurtosis, covar_pop(s, t) / nullif(stddev_pop(s) * stddev_pop(t), 0) AS ic, count(CASE WHEN s > 0 THEN 1 END) / count(*) AS turnover, min(t) AS max_drawdown, max(trade_date) AS ts, CAST(CAST(symbol AS BIGINT) % 5 AS VARCHAR) AS family FROM sc GROUP BY 1),
fl AS (SELECT *, periods < 60 AS flag_short, turnover > 0.5 AS flag_turnover, max_drawdown < -0.7 AS flag_drawdown, ic < 0 AS flag_negative_ic, 10 * coalesce(ic, 0) + coalesce(sharpe, 0) - 0.5 * coalesce(turnover, 0) + coalesce(max_drawdown, 0) AS score FROM rn)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scored(spark, sf_dir).groupBy(F.col("symbol").alias("run")).agg(F.count(F.lit(1)).alias("periods"), X.safe_div(F.avg("t"), F.stddev_samp("t")).alias("sharpe"), X.sample_skew("t").alias("skew"), X.sample_kurtosis("t").alias("kurtosis"), X.correlation("s", "t").alias("ic"), (F.count_if(F.col("s") > 0) / F.count(F.lit(1))).alias("turnover"), F.min("t").alias("max_drawdown"), F.max("trade_date").cast("timestamp").alias("timestamp"))
    return made.withColumn("family", (F.col("run").cast("long") % 5).cast("string"))


@query(f"WITH {_RUN} SELECT run, periods, round(ic, 6) AS ic, coalesce(flag_short, FALSE) AS flag_short, coalesce(flag_turnover, FALSE) AS flag_turnover, coalesce(flag_drawdown, FALSE) AS flag_drawdown, coalesce(flag_negative_ic, FALSE) AS flag_negative_ic, round(score, 5) AS score, CAST(row_number() OVER (ORDER BY round(score, 5) DESC NULLS LAST, run) AS INTEGER) AS place FROM fl")
def run_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = Q.flagged_runs(_runs(spark, sf_dir), 60, 0.5, -0.7).withColumn("score", F.round("score", 5))
    return _r(Q.ranked_runs(flagged).select("run", "periods", "ic", "flag_short", "flag_turnover", "flag_drawdown", "flag_negative_ic", "score", "place"))


@query(f"WITH {_RUN} SELECT run FROM fl WHERE run LIKE '1%' AND ts >= DATE '2001-06-01' AND NOT coalesce(flag_negative_ic, FALSE)")
def run_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = Q.flagged_runs(_runs(spark, sf_dir), 60, 0.5, -0.7)
    return Q.filtered_runs(flagged, "1", "2001-06-01", ["negative_ic"]).select("run")


@query(f"WITH {_RUN} SELECT run, family, count(sharpe) OVER (PARTITION BY family) AS trials, round(var_samp(sharpe) OVER (PARTITION BY family), 6) AS sharpe_variance FROM rn")
def run_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(Q.cohort_statistics(_runs(spark, sf_dir), ["family"]).select("run", "family", "trials", "sharpe_variance"))


@query(f"""WITH {_RUN}, b AS (SELECT family, arg_min(run, CAST(run AS BIGINT)) AS run FROM rn GROUP BY 1), p AS (SELECT c.run, c.family, round(c.sharpe, 6) AS cs, round(c.ic, 6) AS ci, c.periods AS cp, round(x.sharpe, 6) AS bs FROM rn c JOIN b ON CAST(b.family AS BIGINT) = (CAST(c.family AS BIGINT) + CASE WHEN CAST(c.run AS BIGINT) % 7 = 0 THEN 1 ELSE 0 END) % 5 JOIN rn x ON x.run = b.run)
SELECT run, CASE WHEN CAST(run AS BIGINT) % 7 = 0 THEN 'non_comparable' WHEN ci IS NULL OR coalesce(cp < 60, TRUE) THEN 'rejected' WHEN coalesce(cs < bs - 0.05, TRUE) THEN 'reviewable' ELSE 'promotable' END AS verdict FROM p""")
def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _r(_runs(spark, sf_dir)).select("run", "family", "sharpe", "ic", "periods")
    base = runs.groupBy("family").agg(F.min_by(F.struct("sharpe", "periods"), F.col("run").cast("long")).alias("b")).select(F.col("family").alias("b_family"), F.col("b.sharpe").alias("b_sharpe"))
    far = F.when(F.col("run").cast("long") % 7 == 0, 1).otherwise(0)
    pairs = runs.select("run", *(F.col(c).alias(f"c_{c}") for c in ("family", "sharpe", "ic", "periods")), ((F.col("family").cast("long") + far) % 5).cast("string").alias("b_family")).join(F.broadcast(base), "b_family")  # a row for each family
    return Q.promotion(pairs, ["ic"], ["family"], {"periods": 60}, {"sharpe": 0.05}).select("run", "verdict")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS run, count(o_orderpriority) AS issues, CASE max(CASE WHEN o_orderpriority LIKE '5%' OR o_orderpriority LIKE '4%' THEN 1 WHEN o_orderpriority IS NOT NULL THEN CASE WHEN o_orderpriority LIKE '1%' THEN 3 ELSE 2 END END) WHEN 3 THEN 'error' WHEN 2 THEN 'warning' WHEN 1 THEN 'info' END AS worst,
CASE max(CASE WHEN o_orderpriority LIKE '5%' OR o_orderpriority LIKE '4%' THEN 1 WHEN o_orderpriority IS NOT NULL THEN CASE WHEN o_orderpriority LIKE '1%' THEN 3 ELSE 2 END END) WHEN 3 THEN 'red' WHEN 2 THEN 'yellow' ELSE 'green' END AS colour, coalesce(max(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END), 0) = 0 AS passed FROM orders GROUP BY 1""")
def quality_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    severity = F.when(p.like("5%") | p.like("4%"), "info").when(p.like("1%"), "error").when(p.isNotNull(), "warning")
    return Q.quality_verdict(read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("run"), severity.alias("severity")))


# ---- texts, keys, lists

@query("SELECT event_id, CASE WHEN json_extract_string(props, '$.nothing') <> '' THEN json_extract_string(props, '$.nothing') ELSE CASE WHEN json_extract_string(props, '$.k') <> '' THEN json_extract_string(props, '$.k') END END AS found FROM events")
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", X.json_first("props", "nothing", "k").alias("found"))


@query("""SELECT p_partkey, list_filter(list_distinct(string_split_regex(p_type, '[,;|\\s]+')), lambda x: x <> '') IS NOT NULL AS listed, len(list_distinct(list_filter(string_split_regex(coalesce(p_type, ''), '[,;|\\s]+'), lambda x: x <> ''))) AS parts, lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(5, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0') AS code FROM part""")
def list_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", X.tokens("p_type").isNotNull().alias("listed"), F.size(X.tokens("p_type")).cast("long").alias("parts"), X.padded_code(F.concat(F.col("p_partkey").cast("string"), F.lit(".HK"))).alias("code"))


@query("""SELECT o_orderpriority AS raw, count(*) AS n, substr(md5('["' || o_orderpriority || '","' || o_orderstatus || '"]'), 1, 12) AS cohort, o_orderstatus FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY 1, 4""")
def cohort_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").filter("o_orderpriority is not null and o_orderstatus is not null").groupBy(F.col("o_orderpriority").alias("raw"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return o.withColumn("cohort", X.cohort_key("raw", "o_orderstatus"))


@query("SELECT n_name, n_nationkey, 'sma_' || CAST(n_nationkey AS VARCHAR) || '_diff' AS feature, CAST(n_nationkey AS INTEGER) AS win, n_nationkey % 2 = 0 AS connected FROM nation")
def name_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").withColumn("feature", F.concat(F.lit("sma_"), F.col("n_nationkey").cast("string"), F.lit("_diff")))
    flags = F.when(F.col("n_nationkey") % 2 == 0, "sh:no, TRUE").otherwise("false; 0")
    return n.select("n_name", "n_nationkey", "feature", X.feature_window("feature").alias("win"), X.connect_flag(flags).alias("connected"))


@query(f"WITH {_HELD} SELECT entry_date, symbol, place FROM (SELECT *, row_number() OVER (ORDER BY entry_date DESC, place, symbol) AS n FROM held) WHERE n <= 7")
def head_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = P.select(scored(spark, sf_dir), 4).select(F.col("trade_date").alias("entry_date"), "symbol", F.col("place").cast("long").alias("place"))
    return held.orderBy(F.desc_nulls_last("entry_date"), F.asc_nulls_last("place"), "symbol").limit(7)  # the report's size


# ---- resampling and evidence

_PATHS = """sl AS (SELECT a, b, CAST(row_number() OVER (ORDER BY a, b) - 1 AS INTEGER) AS split FROM range(8) x(a), range(8) y(b) WHERE a < b), pt AS (SELECT CAST(g AS INTEGER) AS grp, split, CAST(row_number() OVER (PARTITION BY g ORDER BY split) - 1 AS INTEGER) AS path FROM range(8) z(g) JOIN sl ON g = a OR g = b)"""


def _path_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, g, s) for p, path in enumerate(SP.paths(8, 2)) for g, s in path], "path int, grp int, split int")


@query(f"WITH {PW}, d AS (SELECT trade_date, ntile(8) OVER (ORDER BY trade_date) - 1 AS grp FROM (SELECT DISTINCT trade_date FROM pw)), c AS (SELECT grp, count(*) AS dates FROM d GROUP BY 1), {_PATHS} SELECT path, pt.grp, split, dates FROM pt JOIN c ON c.grp = pt.grp")
def cpcv_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = D.groups(weekly(spark, sf_dir), 8).groupBy("grp").agg(F.count(F.lit(1)).alias("dates"))
    return _path_table(spark).join(sized, "grp").select("path", "grp", "split", "dates")


_CP = f"""{PM}, {SC}, d AS (SELECT trade_date, ntile(8) OVER (ORDER BY trade_date) - 1 AS grp FROM (SELECT DISTINCT trade_date FROM sc)), rr AS (SELECT grp, trade_date, rank() OVER (PARTITION BY trade_date ORDER BY s) + (count(*) OVER (PARTITION BY trade_date, s) - 1) / 2.0 AS a, rank() OVER (PARTITION BY trade_date ORDER BY t) + (count(*) OVER (PARTITION BY trade_date, t) - 1) / 2.0 AS b FROM sc JOIN d USING (trade_date)),
ic AS (SELECT grp, trade_date, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS ic FROM rr GROUP BY 1, 2 HAVING stddev_pop(a) * stddev_pop(b) > 0), gi AS (SELECT grp, avg(ic) AS m, count(*) AS n, sum(ic) AS total FROM ic GROUP BY 1), {_PATHS},
di AS (SELECT s.split, CASE WHEN sum(total) / sum(gi.n) < 0 THEN -1 ELSE 1 END AS sign FROM sl s JOIN gi ON gi.grp <> s.a AND gi.grp <> s.b GROUP BY 1), sgn AS (SELECT pt.path, pt.grp, m * sign AS ic, n FROM pt JOIN gi ON gi.grp = pt.grp JOIN di USING (split)), pm2 AS (SELECT path, count(ic) AS groups, sum(ic * n) / sum(n) AS ic FROM sgn GROUP BY 1)"""


def _cpcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path figures: the direction of every split is learned from its training groups' daily ICs."""
    df = scored(spark, sf_dir)
    groups = D.groups(df, 8)
    ic = S.daily_ic(df).join(F.broadcast(groups), "trade_date")  # a row for each date
    each = ic.groupBy("grp").agg(F.avg("ic").alias("ic"), F.count("ic").alias("n"))  # a row for each group
    table = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(combinations(range(8), 2))], "split int, a int, b int")
    train = each.join(F.broadcast(table), (F.col("grp") != F.col("a")) & (F.col("grp") != F.col("b")))
    sign = train.groupBy("split").agg(F.when(F.sum(F.col("ic") * F.col("n")) / F.sum("n") < 0, -1).otherwise(1).alias("sign"))
    test = each.join(F.broadcast(table), (F.col("grp") == F.col("a")) | (F.col("grp") == F.col("b"))).join(sign, "split")
    return Q.split_paths(test.select("split", F.col("grp").cast("int").alias("grp"), (F.col("ic") * F.col("sign")).alias("ic"), "n"), _path_table(spark))


@query(f"WITH {_CP} SELECT path, groups, round(ic, 6) AS ic FROM pm2")
def cpcv_path_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(_cpcv(spark, sf_dir))


@query(f"WITH {_CP} SELECT count(ic) AS paths, round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS std, round(quantile_cont(ic, 0.05), 6) AS p5, round(quantile_cont(ic, 0.5), 6) AS p50, round(quantile_cont(ic, 0.95), 6) AS p95, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END), 6) AS positive FROM pm2")
def cpcv_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(_cpcv(spark, sf_dir).agg(*Q.spread_of("ic")))


@query(None)
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    day = Window.partitionBy("trade_date")
    z = lambda c: F.coalesce(X.safe_div(F.col(c) - F.avg(c).over(day), F.stddev_pop(c).over(day)), F.lit(0.0))
    made = df.select("trade_date", "symbol", "t", z("s").alias("f_s"), z("vol").alias("f_vol"), z("amount").alias("f_amount"))
    return _r(Q.permutation_drops(made, {"momentum": ["f_s"], "liquidity": ["f_vol", "f_amount"]}, {"f_s": 1.0, "f_vol": 0.5, "f_amount": 0.25}, 5))


@query(f"""WITH {PM}, {SC}, z AS (SELECT trade_date, symbol, t, coalesce((s - avg(s) OVER d) / nullif(stddev_pop(s) OVER d, 0), 0) AS a, coalesce((vol - avg(vol) OVER d) / nullif(stddev_pop(vol) OVER d, 0), 0) AS b FROM sc WINDOW d AS (PARTITION BY trade_date)),
v AS (SELECT 'full' AS run, trade_date, symbol, t, round(a + 0.5 * b, 9) AS score FROM z UNION ALL SELECT 'without_volume', trade_date, symbol, t, round(a, 9) FROM z UNION ALL SELECT 'without_momentum', trade_date, symbol, t, round(0.5 * b, 9) FROM z),
k AS (SELECT *, row_number() OVER (PARTITION BY run, trade_date ORDER BY score DESC, symbol) AS p FROM v), m AS (SELECT run, avg(r) AS mean_return FROM (SELECT run, trade_date, avg(t) AS r FROM k WHERE p <= 5 GROUP BY 1, 2) GROUP BY 1)
SELECT run, round(mean_return, 6) AS mean_return, round(mean_return - (SELECT mean_return FROM m WHERE run = 'full'), 6) AS delta FROM m""")
def ablation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores without one family of features, all in one plan, against the full one."""
    df = scored(spark, sf_dir)
    day = Window.partitionBy("trade_date")
    z = lambda c: F.coalesce(X.safe_div(F.col(c) - F.avg(c).over(day), F.stddev_pop(c).over(day)), F.lit(0.0))
    made = df.select("trade_date", "symbol", "t", z("s").alias("a"), z("vol").alias("b"))
    return _r(Q.ablations(made, {"full": {"a": 1.0, "b": 0.5}, "without_volume": {"a": 1.0}, "without_momentum": {"b": 0.5}}, "full", 5))
