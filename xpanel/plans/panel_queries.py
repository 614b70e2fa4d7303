"""Queries over panels: windows, cross sections, joins and calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import crosssection as CS
from ..operators import dataset as DS
from ..operators import dates as D
from ..operators import joins as J
from ..operators import ranks as RK
from ..operators import timeseries as TS
from .panels import EV, PM, PW, SC, SUP, W, intraday, monthly, read, scored, suppliers, weekly
from .registry import query

R = 6


def _rounded(df: DataFrame, *cs: str, keys: tuple[str, ...] = ("trade_date", "symbol")) -> DataFrame:
    return df.select(*keys, *(F.round(F.col(c).cast("double"), R).alias(c) for c in cs))


def _window_query(name: str, make, sql: str, source=monthly, cte: str = PM, table: str = "pm") -> None:
    """A query of one made column v over a panel."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(make(source(spark, sf_dir)), "v")

    run.__name__ = name
    query(f"WITH {cte} SELECT trade_date, symbol, round(CAST({sql} AS DOUBLE), {R}) AS v FROM {table}" if sql else None)(run)


@query(f"WITH {PM} SELECT * FROM pm")
def panel_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(spark, sf_dir)


@query(f"WITH {PW} SELECT * FROM pw")
def panel_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly(spark, sf_dir)


_N = lambda n: f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_SMA3 = f"CASE WHEN count(close) OVER {_N(3)} >= 3 THEN avg(close) OVER {_N(3)} END"
_window_query("sma_n", lambda p: p.withColumn("v", TS.sma("close", 3)), _SMA3)
_window_query("sma_diff", lambda p: p.withColumn("m", TS.sma("close", 3)).withColumn("v", TS.pct_change("m")), "m / lag(m) OVER (" + W + ") - 1", cte=f"{PM}, x AS (SELECT *, {_SMA3} AS m FROM pm)", table="x")
_window_query("ret_n", lambda p: p.withColumn("v", TS.pct_change("close", 3)), f"close / lag(close, 3) OVER ({W}) - 1")
_RET = f"{PM}, x AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS ret FROM pm)"
_window_query("realized_vol", lambda p: TS.with_return(p).withColumn("v", TS.realized_vol("ret", 6)), f"CASE WHEN count(ret) OVER {_N(6)} >= 6 THEN stddev_pop(ret) OVER {_N(6)} END", cte=_RET, table="x")
_window_query("log_vol", lambda p: p.withColumn("v", F.log1p(F.greatest("vol", F.lit(0.0)))), "ln(1 + greatest(vol, 0))")
_window_query("volume_ratio", lambda p: p.withColumn("v", X.safe_div("vol", TS.sma("vol", 3))), f"CASE WHEN count(vol) OVER {_N(3)} >= 3 THEN vol / nullif(avg(vol) OVER {_N(3)}, 0) END")
_window_query("lagged_adv", lambda p: p.withColumn("v", TS.lagged_mean("amount", 4)), f"avg(amount) OVER ({W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)")
_window_query("lagged_median_adv", lambda p: p.withColumn("v", TS.lagged_median("amount", 4)), f"quantile_cont(amount, 0.5) OVER ({W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)")
_window_query("delta_field", lambda p: p.withColumn("v", TS.delta("vol")), f"vol - lag(vol) OVER ({W})")
_window_query("growth_symmetric", lambda p: p.withColumn("v", TS.growth("amount")), f"(amount - lag(amount) OVER ({W})) / nullif((abs(amount) + abs(lag(amount) OVER ({W}))) / 2, 0)")
_window_query("valuation_percentile", lambda p: p.withColumn("v", TS.value_percentile("close", 12)), f"CASE WHEN count(close) OVER {_N(12)} >= 12 THEN len(list_filter(list(close) OVER {_N(12)}, lambda y: y <= close)) / 12.0 END")
_window_query("valuation_zscore", lambda p: p.withColumn("v", TS.value_zscore("close", 12)), f"CASE WHEN count(close) OVER {_N(12)} >= 12 THEN (ln(close) - avg(ln(close)) OVER {_N(12)}) / nullif(stddev_samp(ln(close)) OVER {_N(12)}, 0) END")
_window_query("rolling_quantile", lambda p: p.withColumn("v", TS.rolling_quantile("close", 12, 0.95)), f"CASE WHEN count(close) OVER {_N(12)} >= 12 THEN quantile_cont(close, 0.95) OVER {_N(12)} END")
_TRIG = f"{PM}, x AS (SELECT *, CASE WHEN count(close) OVER {_N(6)} >= 6 THEN quantile_cont(close, 0.8) OVER {_N(6)} END AS q FROM pm)"
_window_query("cross_up_signal", lambda p: p.withColumn("q", TS.rolling_quantile("close", 6, 0.8)).withColumn("v", TS.cross_up("close", "q").cast("int")), f"CASE WHEN close >= lag(q) OVER ({W}) AND lag(close) OVER ({W}) < lag(q, 2) OVER ({W}) THEN 1 ELSE 0 END", cte=_TRIG, table="x")
_HOLES = f"{PW}, x AS (SELECT *, CASE WHEN CAST(vol AS BIGINT) % 3 <> 0 THEN close END AS hole, row_number() OVER ({W}) AS n FROM pw), y AS (SELECT *, last_value(hole IGNORE NULLS) OVER ({W}) AS f, last_value(CASE WHEN hole IS NOT NULL THEN n END IGNORE NULLS) OVER ({W}) AS fn FROM x)"


def _holes(p: DataFrame) -> DataFrame:
    return p.withColumn("hole", F.when(F.col("vol").cast("long") % 3 != 0, F.col("close")))


_window_query("ffill_limit", lambda p: TS.ffill(_holes(p), "hole", 1, "v"), "CASE WHEN n - fn <= 1 THEN f END", weekly, _HOLES, "y")
_window_query("ffill_all", lambda p: TS.ffill(_holes(p), "hole", None, "v"), "f", weekly, _HOLES, "y")
_window_query("label_fixed", lambda p: p.withColumn("v", X.safe_div(F.lead("close", 3).over(TS.along()), F.lead("close", 1).over(TS.along())) - 1), f"lead(close, 3) OVER ({W}) / nullif(lead(close, 1) OVER ({W}), 0) - 1")
_DAY = "(PARTITION BY trade_date)"
_window_query("winsorize", lambda p: p.withColumn("v", CS.winsorize("close", 0.1)), f"greatest(least(close, quantile_cont(close, 0.9) OVER {_DAY}), quantile_cont(close, 0.1) OVER {_DAY})")
_window_query("zscore", lambda p: p.withColumn("v", CS.zscore("close")), f"coalesce((close - avg(close) OVER {_DAY}) / nullif(stddev_pop(close) OVER {_DAY}, 0), 0)")
_AVG_RANK = lambda c: f"(rank() OVER (PARTITION BY trade_date ORDER BY {c}) + (count(*) OVER (PARTITION BY trade_date, {c}) - 1) / 2.0)"
_window_query("rank_pct", lambda p: p.withColumn("v", CS.rank_pct("vol")), f"{_AVG_RANK('vol')} / count(*) OVER {_DAY} - 0.5")
_window_query("series_transform", lambda p: _holes(p).withColumn("v", CS.keep_nulls("hole", CS.zscore("hole"))), f"CASE WHEN hole IS NOT NULL THEN coalesce((hole - avg(hole) OVER {_DAY}) / nullif(stddev_pop(hole) OVER {_DAY}, 0), 0) END", weekly, _HOLES, "y")
_window_query("style_zscore", lambda p: p.withColumn("v", CS.zscore("vol", fill=False)), f"(vol - avg(vol) OVER {_DAY}) / nullif(stddev_pop(vol) OVER {_DAY}, 0)")
_window_query("composite_zscore", lambda p: p.withColumn("v", CS.composite("close", "vol")), f"(coalesce((close - avg(close) OVER {_DAY}) / nullif(stddev_pop(close) OVER {_DAY}, 0), 0) + coalesce((vol - avg(vol) OVER {_DAY}) / nullif(stddev_pop(vol) OVER {_DAY}, 0), 0)) / 2")
_window_query("neutralize_one", lambda p: p.withColumn("v", CS.neutralize_one("close", "vol")), f"CASE WHEN count(*) OVER {_DAY} >= 3 THEN close - (avg(close) OVER {_DAY} + coalesce(covar_pop(close, vol) OVER {_DAY} / nullif(var_pop(vol) OVER {_DAY}, 0), 0) * (vol - avg(vol) OVER {_DAY})) ELSE close END")
_window_query("median_fill", lambda p: _holes(p).withColumn("v", CS.median_fill("hole")), f"coalesce(hole, quantile_cont(hole, 0.5) OVER {_DAY})", weekly, _HOLES, "y")
_window_query("zero_fill", lambda p: _holes(p).withColumn("v", F.coalesce("hole", F.lit(0.0))), "coalesce(hole, 0)", weekly, _HOLES, "y")
_window_query("missing_flags", lambda p: _holes(p).withColumn("v", CS.missing_flag("hole")), "CASE WHEN hole IS NULL THEN 1 ELSE 0 END", weekly, _HOLES, "y")
_QB = "CASE WHEN count(*) OVER (PARTITION BY trade_date) >= 5 THEN greatest(0, ceil((row_number() OVER (PARTITION BY trade_date ORDER BY close, symbol) - 1) * 5.0 / (count(*) OVER (PARTITION BY trade_date) - 1)) - 1) END"
_window_query("quantile_bucket", lambda p: p.withColumn("v", CS.bucket("close", 5)), _QB)
_window_query("safe_ratio", lambda p: p.withColumn("v", X.safe_div("amount", F.col("vol") - 100)), "amount / nullif(vol - 100, 0)")
_window_query("null_aware_sum", lambda p: _holes(p).withColumn("v", X.null_sum("hole", F.when(F.col("vol") > 50, F.col("vol")))), "CASE WHEN hole IS NULL AND NOT vol > 50 THEN NULL ELSE coalesce(hole, 0) + coalesce(CASE WHEN vol > 50 THEN vol END, 0) END", weekly, _HOLES, "y")
_window_query("combine_first", lambda p: _holes(p).withColumn("v", X.first_of("hole", "vol")), "coalesce(hole, vol)", weekly, _HOLES, "y")
_MK = f"{PM}, r AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS ret FROM pm), m AS (SELECT *, avg(ret) OVER {_DAY} AS mkt FROM r), x AS (SELECT *, CASE WHEN ret IS NOT NULL THEN mkt END AS mx FROM m)"
_window_query("rolling_beta", lambda p: TS.with_return(p).withColumn("mkt", F.avg("ret").over(CS.by_date())).withColumn("v", TS.rolling_beta("ret", "mkt", 24, 12)), f"CASE WHEN count(mx) OVER {_N(24)} >= 12 THEN covar_pop(ret, mx) OVER {_N(24)} / nullif(var_pop(mx) OVER {_N(24)}, 0) END", cte=_MK, table="x")
_window_query("sample_weight_date", lambda p: p.withColumn("v", 1 / F.count(F.lit(1)).over(CS.by_date())), f"1.0 / count(*) OVER {_DAY}")


@query(f"""WITH RECURSIVE {PM}, o AS (SELECT symbol, trade_date, close - lag(close) OVER ({W}) AS d, row_number() OVER ({W}) - 1 AS n FROM pm),
e AS (SELECT symbol, n, trade_date, greatest(d, 0) AS up, greatest(-d, 0) AS down FROM o WHERE n = 1
  UNION ALL SELECT o.symbol, o.n, o.trade_date, e.up + (greatest(o.d, 0) - e.up) / 6, e.down + (greatest(-o.d, 0) - e.down) / 6 FROM e JOIN o ON o.symbol = e.symbol AND o.n = e.n + 1)
SELECT trade_date, symbol, round(CASE WHEN n >= 6 AND up + down > 0 THEN 100 * up / (up + down) END, 6) AS rsi FROM e""")
def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(TS.rsi(monthly(spark, sf_dir), "close", 6), "rsi")


@query(f"""WITH RECURSIVE {PM}, o AS (SELECT symbol, trade_date, close, row_number() OVER ({W}) AS n FROM pm),
e AS (SELECT symbol, n, trade_date, close AS v FROM o WHERE n = 1
  UNION ALL SELECT o.symbol, o.n, o.trade_date, e.v + 2.0 / 13 * (o.close - e.v) FROM e JOIN o ON o.symbol = e.symbol AND o.n = e.n + 1)
SELECT trade_date, symbol, round(v, 6) AS ema FROM e""")
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(TS.ema(monthly(spark, sf_dir), "close", 12, "ema"), "ema")


@query(f"""WITH RECURSIVE {PM}, o AS (SELECT symbol, trade_date, close, row_number() OVER ({W}) AS n FROM pm),
e AS (SELECT symbol, n, trade_date, close AS f, close AS s, 0.0::DOUBLE AS line FROM o WHERE n = 1
  UNION ALL SELECT symbol, n, trade_date, f, s, line + 2.0 / 10 * ((f - s) - line) FROM (
    SELECT o.symbol, o.n, o.trade_date, e.f + 2.0 / 13 * (o.close - e.f) AS f, e.s + 2.0 / 27 * (o.close - e.s) AS s, e.line FROM e JOIN o ON o.symbol = e.symbol AND o.n = e.n + 1))
SELECT trade_date, symbol, round(f - s - line, 6) AS macd_hist FROM e""")
def macd_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(TS.macd_hist(monthly(spark, sf_dir)), "macd_hist")


@query(f"""WITH {PM}, a AS (SELECT trade_date, symbol, close - avg(close) OVER d AS y, vol - avg(vol) OVER d AS x1, ln(1 + vol) - avg(ln(1 + vol)) OVER d AS x2, count(*) OVER d AS n, close FROM pm WINDOW d AS (PARTITION BY trade_date)),
b AS (SELECT *, x2 - coalesce(sum(x1 * x2) OVER d / nullif(sum(x1 * x1) OVER d, 0), 0) * x1 AS z2, y - coalesce(sum(x1 * y) OVER d / nullif(sum(x1 * x1) OVER d, 0), 0) * x1 AS y2, sum(x2 * x2) OVER d AS s2 FROM a WINDOW d AS (PARTITION BY trade_date)),
c AS (SELECT *, sum(z2 * z2) OVER d AS q, sum(z2 * y2) OVER d AS p FROM b WINDOW d AS (PARTITION BY trade_date))
SELECT trade_date, symbol, round(CASE WHEN n < 3 THEN close ELSE y2 - CASE WHEN q > 1e-10 * s2 THEN p / q * z2 ELSE 0 END END, 5) AS neutral FROM c""")
def neutralize_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = CS.neutralize(monthly(spark, sf_dir).withColumn("lv", F.log1p("vol")), "close", ["vol", "lv"])
    return made.select("trade_date", "symbol", F.round("neutral", 5).alias("neutral"))


@query(f"WITH {PM} SELECT trade_date, symbol, n FROM (SELECT *, count(*) OVER (PARTITION BY trade_date) AS n FROM pm) WHERE n >= 9")
def min_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = CS.least_symbols(monthly(spark, sf_dir), 9)
    return good.select("trade_date", "symbol", F.count(F.lit(1)).over(CS.by_date()).alias("n"))


@query(f"WITH {_HOLES} SELECT trade_date, symbol, hole FROM y WHERE hole IS NOT NULL AND vol IS NOT NULL")
def complete_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CS.complete_case(_holes(weekly(spark, sf_dir)), "hole", "vol").select("trade_date", "symbol", "hole")


@query(f"WITH {PM} SELECT trade_date, symbol, place FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY close DESC, symbol) AS place, count(*) OVER (PARTITION BY trade_date) AS n FROM pm) WHERE place <= 5 AND n >= 5")
def top_k_per_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CS.top_k(monthly(spark, sf_dir), "close", 5).select("trade_date", "symbol", F.col("place").cast("long").alias("place"))


@query(None)
def permute_within_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CS.permute(monthly(spark, sf_dir), "close", 7).select("trade_date", "symbol", "permuted")


for _unit, _sql in (("week", "week"), ("month", "month"), ("quarter", "quarter")):

    def _reb(spark: SparkSession, sf_dir: str, unit: str = _unit) -> DataFrame:
        return D.rebalance_dates(weekly(spark, sf_dir), unit)

    _reb.__name__ = f"rebalance_dates_{_unit}"
    query(f"WITH {PW} SELECT max(trade_date) AS rebalance_date FROM pw GROUP BY date_trunc('{_sql}', trade_date)")(_reb)

_REB = "reb AS (SELECT max(trade_date) AS rebalance_date FROM pw GROUP BY date_trunc('quarter', trade_date))"
_CAL = "cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS idx FROM (SELECT DISTINCT trade_date FROM pw))"


@query(f"WITH {PW}, {_REB}, {_CAL}, g AS (SELECT idx - lag(idx) OVER (ORDER BY idx) AS g FROM cal JOIN reb ON trade_date = rebalance_date) SELECT CAST(floor(quantile_cont(g, 0.5) + 0.5) AS BIGINT) AS gap FROM g")
def rebalance_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.rebalance_gap(weekly(spark, sf_dir), "quarter")


@query(f"WITH {PW}, {_REB} SELECT DISTINCT trade_date, (SELECT min(rebalance_date) FROM reb WHERE rebalance_date > trade_date) AS next_rebalance FROM pw")
def next_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.next_rebalance(weekly(spark, sf_dir), "quarter")


@query(f"""WITH {PW}, {_REB}, nx AS (SELECT trade_date, symbol, close, (SELECT min(rebalance_date) FROM reb WHERE rebalance_date > pw.trade_date) AS nr FROM pw)
SELECT a.trade_date, a.symbol, round(b.close / nullif(a.close, 0) - 1, 6) AS v FROM nx a LEFT JOIN pw b ON b.symbol = a.symbol AND b.trade_date = a.nr""")
def label_next_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(DS.label_to_rebalance(weekly(spark, sf_dir), "quarter", name="v"), "v")


@query(f"WITH {PW}, {_CAL} SELECT c.trade_date, d.trade_date AS shifted FROM cal c LEFT JOIN cal d ON d.idx = c.idx + 3")
def trading_day_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal = D.calendar(weekly(spark, sf_dir))
    return D.shift(cal.select("trade_date"), cal, 3).select("trade_date", "shifted")


@query(f"WITH {PW}, {_CAL} SELECT c.trade_date, d.trade_date AS start, e.trade_date AS stop FROM cal c LEFT JOIN cal d ON d.idx = c.idx + 1 LEFT JOIN cal e ON e.idx = c.idx + 5")
def label_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = weekly(spark, sf_dir)
    return D.label_windows(p, D.calendar(p), 4, 1).select("trade_date", "start", "stop")


_EW = f"{PW}, {_CAL}, w AS (SELECT c.trade_date, c.idx, d.trade_date AS start, e.trade_date AS stop FROM cal c JOIN cal d ON d.idx = c.idx + 1 JOIN cal e ON e.idx = c.idx + 5), tst AS (SELECT * FROM w WHERE idx % 60 < 4)"


@query(f"WITH {_EW} SELECT trade_date FROM w a WHERE EXISTS (SELECT 1 FROM tst b WHERE a.start <= b.stop + INTERVAL 5 DAY AND b.start <= a.stop)")
def event_overlap_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = weekly(spark, sf_dir)
    cal = D.calendar(p)
    w = D.label_windows(p, cal, 4, 1).filter("stop is not null").join(cal, "trade_date")
    return J.overlapping(w, w.filter("idx % 60 < 4"), 5).select("trade_date")


@query(f"WITH {PW}, d AS (SELECT DISTINCT trade_date FROM pw) SELECT trade_date, ntile(8) OVER (ORDER BY trade_date) - 1 AS grp FROM d")
def cpcv_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.groups(weekly(spark, sf_dir), 8).select("trade_date", F.col("grp").cast("long").alias("grp"))


_UNI = "uni AS (SELECT trade_date AS rebalance_date, symbol FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, symbol) AS n FROM pm WHERE month(trade_date) % 3 = 1) WHERE n <= 6)"


def _universe(p: DataFrame) -> DataFrame:
    return CS.top_k(p.filter(F.month("trade_date") % 3 == 1), "amount", 6, whole=False).select(F.col("trade_date").alias("rebalance_date"), "symbol")


@query(f"WITH {PM}, {_UNI}, m AS (SELECT DISTINCT trade_date, (SELECT max(rebalance_date) FROM uni WHERE rebalance_date <= trade_date) AS rebalance_date FROM pm) SELECT pm.trade_date, rebalance_date, pm.symbol FROM pm JOIN m USING (trade_date) JOIN uni USING (rebalance_date, symbol)")
def universe_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = monthly(spark, sf_dir)
    return J.universe_asof(p, _universe(p)).select("trade_date", "rebalance_date", "symbol")


_FUND = "fund AS (SELECT trade_date, symbol, amount AS revenue, vol AS units FROM pm WHERE month(trade_date) % 3 = 0)"


def _fundamentals(p: DataFrame) -> DataFrame:
    return p.filter(F.month("trade_date") % 3 == 0).select("trade_date", "symbol", F.col("amount").alias("revenue"), F.col("vol").alias("units"))


@query(f"WITH {PM}, {PW}, {_FUND} SELECT pw.trade_date, pw.symbol, revenue, date_diff('day', fund.trade_date, pw.trade_date) AS age FROM pw ASOF LEFT JOIN fund ON pw.symbol = fund.symbol AND pw.trade_date >= fund.trade_date")
def asof_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = J.asof(weekly(spark, sf_dir), _fundamentals(monthly(spark, sf_dir)), ["symbol"], "trade_date", ["revenue"], "age")
    return made.select("trade_date", "symbol", "revenue", F.col("age").cast("long").alias("age"))


@query(f"WITH {PM}, {_FUND} SELECT pm.trade_date, pm.symbol, revenue FROM pm LEFT JOIN fund USING (trade_date, symbol)")
def exact_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = monthly(spark, sf_dir)
    return J.exact(p, _fundamentals(p), ["trade_date", "symbol"], ["revenue"]).select("trade_date", "symbol", "revenue")


@query(f"WITH {PM}, {_FUND} SELECT pm.trade_date, pm.symbol, revenue AS amount FROM pm LEFT JOIN fund USING (trade_date, symbol)")
def overlay_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = monthly(spark, sf_dir)
    return J.overlay(p, _fundamentals(p).withColumnRenamed("revenue", "amount"), ["trade_date", "symbol"], ["amount"]).select("trade_date", "symbol", "amount")


@query(f"WITH {PM} SELECT symbol, max_by(close, trade_date) FILTER (close IS NOT NULL) AS value FROM pm WHERE trade_date <= DATE '1998-06-15' GROUP BY symbol")
def value_lookup_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.value_at(monthly(spark, sf_dir), "symbol", "close", "1998-06-15")


@query(f"WITH {PM} SELECT symbol, close AS value FROM pm WHERE trade_date = DATE '1998-06-01'")
def value_lookup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.value_at(monthly(spark, sf_dir), "symbol", "close", "1998-06-01", exact=True)


@query(f"WITH {PM}, {_UNI}, lst AS (SELECT DISTINCT rebalance_date FROM uni ORDER BY 1 DESC LIMIT 2), a AS (SELECT symbol FROM uni WHERE rebalance_date = (SELECT max(rebalance_date) FROM lst)), b AS (SELECT symbol FROM uni WHERE rebalance_date = (SELECT min(rebalance_date) FROM lst)) SELECT symbol FROM a WHERE symbol NOT IN (SELECT symbol FROM b)")
def new_members_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.newcomers(_universe(monthly(spark, sf_dir)), "rebalance_date", "symbol")


@query(f"""WITH {PM}, d AS (SELECT DISTINCT trade_date FROM pm ORDER BY 1 DESC LIMIT 2), n AS (SELECT symbol, vol FROM pm WHERE trade_date = (SELECT max(trade_date) FROM d) AND vol > 0 AND CAST(vol AS BIGINT) % 3 <> 0), o AS (SELECT symbol, vol FROM pm WHERE trade_date = (SELECT min(trade_date) FROM d) AND vol > 0 AND CAST(vol AS BIGINT) % 3 <> 0)
SELECT symbol, o.vol AS old_value, n.vol AS new_value, CASE WHEN o.vol IS NULL THEN 'added' WHEN n.vol IS NULL THEN 'removed' ELSE 'changed' END AS status FROM n FULL JOIN o USING (symbol) WHERE o.vol IS NULL OR n.vol IS NULL OR abs(n.vol - o.vol) >= 1e-12""")
def rebalance_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = monthly(spark, sf_dir)
    last = p.select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(2)
    two = p.filter("vol > 0 and cast(vol as bigint) % 3 <> 0").join(F.broadcast(last), "trade_date")
    both = last.agg(F.max("trade_date").alias("hi"), F.min("trade_date").alias("lo"))
    two = two.join(F.broadcast(both), (F.col("trade_date") == F.col("hi")) | (F.col("trade_date") == F.col("lo")))
    return J.diff(two.filter("trade_date = hi"), two.filter("trade_date = lo"), ["symbol"], "vol").select("symbol", "old_value", "new_value", "status")


@query("WITH x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM x WHERE n = 1")
def dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.keep_last(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("WITH x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM x WHERE n = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.keep_last(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], first=True).select("o_custkey", "o_orderkey", "o_totalprice")


@query(f"WITH {EV} SELECT symbol, trade_date, arg_min(price, (ts, event_id)) AS open, arg_max(price, (ts, event_id)) AS close, max(price) AS high, min(price) AS low, count(*) AS n, CAST(sum(event_id % 90 + 10) AS DOUBLE) AS volume, round(sum(price * (event_id % 90 + 10)), 4) AS amount, round(sum(price * (event_id % 90 + 10)) / sum(event_id % 90 + 10), 6) AS vwap FROM ev GROUP BY 1, 2")
def session_vwap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = intraday(spark, sf_dir).withColumn("size", (F.col("event_id") % 90 + 10).cast("double"))
    return _rounded(TS.session_bars(ticks, ("symbol", "trade_date"), ("ts", "event_id")), "open", "close", "high", "low", "n", "volume", "amount", "vwap", keys=("symbol", "trade_date")).withColumns({"n": F.col("n").cast("long"), "amount": F.round("amount", 4)})


@query(f"""WITH {EV}, bar AS (SELECT symbol, trade_date, arg_min(price, (ts, event_id)) AS o, max(price) AS h, min(price) AS l, arg_max(price, (ts, event_id)) AS c, CAST(sum(event_id % 90 + 10) AS DOUBLE) AS v FROM ev GROUP BY 1, 2)
SELECT symbol, CAST(date_trunc('month', trade_date) AS DATE) AS month, count(*) AS bars, round(sum(v), 4) AS volume, round(sum((o + h + l + c) / 4 * v) / nullif(sum(v), 0), 6) AS vwap FROM bar GROUP BY 1, 2""")
def bar_vwap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month's volume-weighted mean of daily bars; a tick's size is made of its event_id, as the table has none."""
    ticks = intraday(spark, sf_dir).withColumn("size", (F.col("event_id") % 90 + 10).cast("double"))
    bars = TS.session_bars(ticks, ("symbol", "trade_date"), ("ts", "event_id")).withColumn("month", F.trunc("trade_date", "MM"))
    return TS.bar_vwap(bars, ("symbol", "month")).select("symbol", "month", "bars", F.round("volume", 4).alias("volume"), F.round("vwap", R).alias("vwap"))


def snapshot(df: DataFrame, c: str) -> DataFrame:
    """count, mean, median, population deviation and outer percentiles of a column; the percentiles are exact and need no task with all values."""
    shares = {"median": 0.5, "p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9}
    found = RK.quantiles(df, c, list(shares.values()))
    wide = found.agg(*(F.round(F.max(F.when(F.col("share") == p, F.col("value"))), R).alias(n) for n, p in shares.items()))  # a row for each share
    return df.agg(F.count(c).alias("n"), F.round(F.avg(c), R).alias("mean"), F.round(F.stddev_pop(c), R).alias("std")).crossJoin(wide)


@query("SELECT count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90 FROM events")
def metric_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(read(spark, sf_dir, "events"), "value")


@query(f"""WITH {PM}, d AS (SELECT symbol, avg(amount) AS adv FROM pm GROUP BY symbol), r AS (SELECT *, row_number() OVER (ORDER BY adv, symbol) AS p, count(*) OVER () AS n FROM d), b AS (SELECT *, CAST(greatest(0, ceil((p - 1) * 5.0 / (n - 1)) - 1) AS INTEGER) AS bucket FROM r)
SELECT bucket, count(*) AS n, round(min(adv), 4) AS lo, round(quantile_cont(adv, 0.5), 4) AS mid, round(quantile_cont(adv, 0.75), 4) AS p75, round(quantile_cont(adv, 0.9), 4) AS p90, round(max(adv), 4) AS hi FROM b GROUP BY bucket""")
def liquidity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = monthly(spark, sf_dir).groupBy("symbol").agg(X.steady_mean("amount").alias("adv"))  # a symbol's months
    placed = RK.numbered(d, "adv", "symbol").withColumn("bucket", X.quantile_bucket("position", "n", 5)).drop("n")
    made = RK.part_quantiles(placed, "bucket", "adv", {"lo": 0.0, "mid": 0.5, "p75": 0.75, "p90": 0.9, "hi": 1.0})
    return made.select("bucket", "n", *(F.round(c, 4).alias(c) for c in ("lo", "mid", "p75", "p90", "hi")))


@query(f"WITH {PM}, {SUP} SELECT trade_date, symbol, close FROM pm JOIN sup USING (symbol) WHERE industry NOT LIKE '%1%' AND cap > 0")
def universe_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name match, positive cap and membership as semi joins on the small side."""
    good = suppliers(spark, sf_dir).filter((F.col("cap") > 0) & ~F.col("industry").like("%1%"))
    return monthly(spark, sf_dir).join(good.select("symbol"), "symbol", "left_semi").select("trade_date", "symbol", "close")


@query(f"WITH {PM}, l AS (SELECT symbol, min(trade_date) AS listed FROM pm GROUP BY symbol) SELECT trade_date, symbol FROM pm JOIN l USING (symbol) WHERE trade_date >= listed + INTERVAL 180 DAY")
def listing_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DS.of_age(monthly(spark, sf_dir), 180).select("trade_date", "symbol")


@query(f"WITH {PM} SELECT trade_date, symbol, vol > 0 AND amount > 0 AND NOT vol < 300 AS is_tradable FROM pm WHERE amount >= 100000")
def tradability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = monthly(spark, sf_dir).filter("amount >= 100000")
    return DS.tradable(rows, least_volume=300).select("trade_date", "symbol", "is_tradable")


@query("SELECT o_orderpriority AS raw, lower(o_orderpriority) IN ('1', 'true', 't', 'yes', 'y') AS truth, CAST(trim(regexp_replace(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS VARCHAR) AS slug, count(*) AS n FROM orders GROUP BY 1")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("raw")).agg(F.count(F.lit(1)).alias("n")).select("raw", X.truthy("raw").alias("truth"), X.slug("raw").alias("slug"), "n")


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) AS parsed FROM orders")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return d.select("d", X.parse_date(F.concat(F.date_format("d", "yyyyMMdd"), F.lit(".0"))).alias("parsed"))


@query(f"WITH {SUP} SELECT coalesce(industry, '?') AS industry, count(DISTINCT symbol) AS symbols, string_agg(DISTINCT symbol, '|' ORDER BY symbol) AS members FROM sup GROUP BY 1")
def distinct_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppliers(spark, sf_dir).groupBy(F.coalesce("industry", F.lit("?")).alias("industry")).agg(F.countDistinct("symbol").alias("symbols"), F.array_join(F.array_sort(F.collect_set("symbol")), "|").alias("members"))


@query("WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS k, sum(n) OVER (PARTITION BY c_nationkey) AS total FROM c) SELECT c_nationkey, c_mktsegment AS mode, round(n / total, 6) AS share FROM r WHERE k = 1")
def mode_and_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    best = c.withColumn("k", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("n"), "c_mktsegment"))).withColumn("total", F.sum("n").over(Window.partitionBy("c_nationkey")))
    return best.filter("k = 1").select("c_nationkey", F.col("c_mktsegment").alias("mode"), F.round(F.col("n") / F.col("total"), R).alias("share"))


@query(f"""WITH {PM}, a AS (SELECT DISTINCT trade_date FROM pm WHERE month(trade_date) <> 2), b AS (SELECT DISTINCT trade_date FROM pm WHERE month(trade_date) <> 5), c AS (SELECT DISTINCT trade_date FROM pm WHERE year(trade_date) = 1996)
SELECT trade_date FROM a INTERSECT SELECT trade_date FROM b EXCEPT SELECT trade_date FROM c""")
def calendar_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = monthly(spark, sf_dir).select("trade_date").distinct()
    return d.filter(F.month("trade_date") != 2).intersect(d.filter(F.month("trade_date") != 5)).exceptAll(d.filter(F.year("trade_date") == 1996))


# statement items made of the panel's columns, so that every ratio has its inputs
_ITEMS = {
    "revenue": "amount", "net_profit": "amount * 0.1 - vol", "operating_profit": "amount * 0.15 - vol", "cash_flow_from_operating_activities": "amount * 0.12 - close", "total_assets": "amount + close * 100", "total_liabilities": "close * 60", "total_equity": "amount - close * 20",
    "cash_and_equivalents": "vol * 10", "goodwill": "close", "accounts_receivable": "amount * 0.2", "inventory": "vol * 5", "current_assets": "amount * 0.5", "current_liabilities": "close * 30", "total_debt": "close * 40",
}
_RATIO_SQL = {
    "profit_margin": "net_profit / nullif(revenue, 0)", "operating_margin": "operating_profit / nullif(revenue, 0)", "cfo_margin": "cash_flow_from_operating_activities / nullif(revenue, 0)", "cfo_to_profit": "cash_flow_from_operating_activities / nullif(net_profit, 0)",
    "asset_turnover": "revenue / nullif(total_assets, 0)", "roa": "net_profit / nullif(total_assets, 0)", "leverage": "total_liabilities / nullif(total_assets, 0)", "cfo_to_assets": "cash_flow_from_operating_activities / nullif(total_assets, 0)",
    "debt_to_assets": "total_debt / nullif(total_assets, 0)", "debt_to_equity": "total_debt / nullif(total_equity, 0)", "cash_to_assets": "cash_and_equivalents / nullif(total_assets, 0)", "goodwill_to_assets": "goodwill / nullif(total_assets, 0)",
    "accrual_ratio": "(net_profit - cash_flow_from_operating_activities) / nullif(total_assets, 0)", "receivables_to_revenue": "accounts_receivable / nullif(revenue, 0)", "inventory_to_revenue": "inventory / nullif(revenue, 0)",
    "working_capital_to_assets": "(current_assets - current_liabilities) / nullif(total_assets, 0)", "net_debt_to_assets": "(total_debt - cash_and_equivalents) / nullif(total_assets, 0)",
}


@query(f"WITH {PM}, st AS (SELECT trade_date, symbol, " + ", ".join(f"{e} AS {n}" for n, e in _ITEMS.items()) + " FROM pm) SELECT trade_date, symbol, " + ", ".join(f"round({e}, {R}) AS {n}" for n, e in _RATIO_SQL.items()) + " FROM st")
def ratio_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = monthly(spark, sf_dir).select("trade_date", "symbol", *(F.expr(e).alias(n) for n, e in _ITEMS.items()))
    return _rounded(items.select("trade_date", "symbol", *(r.alias(n) for n, r in X.financial_ratios(items.columns).items())), *_RATIO_SQL)


@query(f"WITH {PM}, {SC}, x AS (SELECT count(*) AS n, max(trade_date) AS last FROM sc), d AS (SELECT trade_date, pow(0.5, date_diff('day', trade_date, last) / 365.0) AS raw FROM (SELECT DISTINCT trade_date FROM sc), x), m AS (SELECT avg(raw) AS mean FROM d) SELECT sc.trade_date, symbol, round(raw / mean / count(*) OVER (PARTITION BY sc.trade_date), 9) AS weight FROM sc JOIN d USING (trade_date), m")
def sample_weight_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.splits import decay_weights

    return decay_weights(scored(spark, sf_dir), half_life_days=365).select("trade_date", "symbol", F.round("weight", 9).alias("weight"))


@query("SELECT CAST(p AS DOUBLE) AS p, round(CAST(q AS DOUBLE), 4) AS q FROM (VALUES (0.025, -1.959964), (0.5, 0.0), (0.841344746, 1.0), (0.999, 3.090232)) AS t(p, q)")
def normal_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.createDataFrame([(0.025,), (0.5,), (0.841344746,), (0.999,)], "p double")
    return p.select("p", (F.round(X.norm_ppf("p"), 4) + 0.0).alias("q"))
