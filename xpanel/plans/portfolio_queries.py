"""Queries about portfolios, costs, capacity, return statistics, benchmarks and live allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import benchmarks as B
from ..operators import portfolio as P
from ..operators import returns as T
from .panels import IX, PM, PW, SC, SUP, index_series, monthly, read, scored, suppliers, weekly
from .registry import query

R = 6


def _r(df: DataFrame, **digits: int) -> DataFrame:
    return df.select(*(F.round(c, digits.get(c, R)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_SEL = f"{PM}, {SC}, rk AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY s DESC, symbol) AS place FROM sc), held AS (SELECT trade_date, symbol, place, s, close FROM rk WHERE place <= 4)"


@query(f"WITH {_SEL} SELECT trade_date, symbol, place FROM held")
def topk_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.select(scored(spark, sf_dir), 4).select("trade_date", "symbol", F.col("place").cast("long").alias("place"))


@query(f"""WITH {_SEL}, z AS (SELECT *, coalesce((s - avg(s) OVER d) / nullif(stddev_pop(s) OVER d, 0), 0) AS z FROM held WINDOW d AS (PARTITION BY trade_date)), e AS (SELECT *, exp(greatest(-5, least(z, 5))) AS e FROM z)
SELECT trade_date, symbol, round(e / sum(e) OVER (PARTITION BY trade_date), 6) AS weight FROM e""")
def signal_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(P.weights(P.select(scored(spark, sf_dir), 4), "signal").select("trade_date", "symbol", "weight"))


@query(f"""WITH {PM}, {SC}, {SUP}, j AS (SELECT sc.*, industry FROM sc LEFT JOIN sup USING (symbol)), g AS (SELECT *, row_number() OVER (PARTITION BY trade_date, industry ORDER BY s DESC, symbol) AS g FROM j WHERE close >= 1000),
p AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY s DESC, symbol) AS place FROM g WHERE industry IS NULL OR g <= 1) SELECT trade_date, symbol, place FROM p WHERE place <= 4""")
def group_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir).join(suppliers(spark, sf_dir), "symbol", "left")
    return P.select(df, 4, c=P.Constraints(least_price=1000, group="industry", most_of_group=1)).select("trade_date", "symbol", F.col("place").cast("long").alias("place"))


_PRICED = f"""{_SEL}, d AS (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS exit_date FROM (SELECT DISTINCT trade_date FROM sc)),
pr AS (SELECT held.trade_date, d.exit_date, held.symbol, 1.0 / count(*) OVER (PARTITION BY held.trade_date) AS weight, held.close AS entry_price, x.close AS exit_price FROM held JOIN d USING (trade_date) LEFT JOIN sc x ON x.symbol = held.symbol AND x.trade_date = d.exit_date WHERE d.exit_date IS NOT NULL),
sv AS (SELECT * FROM pr WHERE exit_price IS NOT NULL),
gr AS (SELECT trade_date, exit_date, sum(weight * (exit_price / entry_price - 1)) / sum(weight) AS gross, count(*) AS n FROM sv GROUP BY 1, 2),
dd AS (SELECT trade_date, lag(trade_date) OVER (ORDER BY trade_date) AS prev FROM (SELECT DISTINCT trade_date FROM sv)),
dr AS (SELECT trade_date AS prev, symbol, weight * exit_price / entry_price / sum(weight * exit_price / entry_price) OVER (PARTITION BY trade_date) AS drifted FROM sv),
bf AS (SELECT dd.trade_date, symbol, drifted FROM dr JOIN dd USING (prev)),
tu AS (SELECT coalesce(a.trade_date, b.trade_date) AS trade_date, sum(abs(coalesce(a.weight, 0) - coalesce(b.drifted, 0))) AS moved, max(b.drifted) IS NULL AS initial FROM sv a FULL JOIN bf b ON a.trade_date = b.trade_date AND a.symbol = b.symbol GROUP BY 1),
bt AS (SELECT trade_date, exit_date, gross, CASE WHEN initial THEN moved ELSE moved / 2 END AS turnover, CASE WHEN initial THEN 0.001 ELSE moved * 0.001 END AS fee FROM gr JOIN tu USING (trade_date)),
rs AS (SELECT trade_date, gross - fee AS r FROM bt)"""


@query(f"WITH {_PRICED} SELECT trade_date, exit_date, round(gross, 6) AS gross, n FROM gr")
def period_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    held = P.weights(P.select(df, 4)).select("trade_date", "symbol", "weight", F.col("close").alias("entry_price")).join(F.broadcast(P.periods(df)), "trade_date")
    return _r(P.period_returns(P.exits(held, df.select("symbol", "trade_date", "close"))))


@query(f"WITH {_PRICED} SELECT trade_date, exit_date, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(fee, 6) AS fee, round(gross - fee, 6) AS net FROM bt")
def topk_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(P.backtest(scored(spark, sf_dir), 4))


def _net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.backtest(scored(spark, sf_dir), 4).select("trade_date", F.col("net").alias("r"))


def _leg(x: str, order: str, k: int = 4, room: str = "TRUE", exit_: int = 0, entry: int = 0, signal: bool = False, price_in: str = "close") -> str:
    """The CTEs of one leg, names ending in x: bt{x} has gross, turnover, fee of its periods. A band makes them recursive; signal: weights by the score."""
    held = f"held{x} AS (SELECT * FROM rk{x} WHERE place <= {k} AND {room})"
    if exit_ or entry:
        held = f"""nm{x} AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i, names FROM (SELECT trade_date, list(symbol ORDER BY place) AS names FROM rk{x} WHERE place <= {k + exit_} GROUP BY 1)),
f{x} AS (SELECT i, trade_date, names[:{k}] AS held FROM nm{x} WHERE i = 1 UNION ALL SELECT i, trade_date, list_concat(pool, list_filter(names, lambda z: NOT list_contains(pool, z)))[:{k}] FROM (
  SELECT i, trade_date, names, list_concat(kept, list_filter(names[:{k - entry}], lambda z: NOT list_contains(kept, z))) AS pool FROM (
    SELECT nm{x}.i, nm{x}.trade_date, nm{x}.names, list_filter(nm{x}.names, lambda z: list_contains(f{x}.held, z)) AS kept FROM f{x} JOIN nm{x} ON nm{x}.i = f{x}.i + 1))),
hn{x} AS (SELECT trade_date, unnest(held) AS symbol FROM f{x}), held{x} AS (SELECT rk{x}.* FROM rk{x} JOIN hn{x} USING (trade_date, symbol) WHERE {room})"""
    weight = f"1.0 / count(*) OVER (PARTITION BY held{x}.trade_date)"
    if signal:
        held += f", zz{x} AS (SELECT *, exp(greatest(-5, least(coalesce((s - avg(s) OVER w) / nullif(stddev_pop(s) OVER w, 0), 0), 5))) AS e FROM held{x} WINDOW w AS (PARTITION BY trade_date))"
        weight = f"e / sum(e) OVER (PARTITION BY held{x}.trade_date)"
    source = f"zz{x} AS held{x}" if signal else f"held{x}"
    return f"""rk{x} AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY {order}, symbol) AS place, count(*) OVER (PARTITION BY trade_date) AS n FROM sc), {held},
pr{x} AS (SELECT held{x}.trade_date, d.exit_date, held{x}.symbol, {weight} AS weight, held{x}.{price_in} AS entry_price, y.close AS exit_price FROM {source} JOIN d USING (trade_date) LEFT JOIN sc y ON y.symbol = held{x}.symbol AND y.trade_date = d.exit_date WHERE d.exit_date IS NOT NULL),
sv{x} AS (SELECT * FROM pr{x} WHERE exit_price IS NOT NULL), gr{x} AS (SELECT trade_date, exit_date, sum(weight * (exit_price / entry_price - 1)) / sum(weight) AS gross FROM sv{x} GROUP BY 1, 2),
dd{x} AS (SELECT trade_date, lag(trade_date) OVER (ORDER BY trade_date) AS prev FROM (SELECT DISTINCT trade_date FROM sv{x})),
bf{x} AS (SELECT dd{x}.trade_date, symbol, drifted FROM (SELECT trade_date AS prev, symbol, weight * exit_price / entry_price / sum(weight * exit_price / entry_price) OVER (PARTITION BY trade_date) AS drifted FROM sv{x}) JOIN dd{x} USING (prev)),
tu{x} AS (SELECT coalesce(a.trade_date, b.trade_date) AS trade_date, sum(abs(coalesce(a.weight, 0) - coalesce(b.drifted, 0))) AS moved, max(b.drifted) IS NULL AS initial FROM sv{x} a FULL JOIN bf{x} b ON a.trade_date = b.trade_date AND a.symbol = b.symbol GROUP BY 1),
bt{x} AS (SELECT trade_date, exit_date, gross, CASE WHEN initial THEN moved ELSE moved / 2 END AS turnover, CASE WHEN initial THEN 0.001 ELSE moved * 0.001 END AS fee FROM gr{x} JOIN tu{x} USING (trade_date))"""


_DATES = "d AS (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS exit_date FROM (SELECT DISTINCT trade_date FROM sc))"
_BT = "trade_date, exit_date, round({0}, 6) AS gross, round({1}, 6) AS turnover, round({2}, 6) AS fee, round({0} - ({2}), 6) AS net"


@query(f"WITH {PM}, {SC.replace('SELECT *, round(signal', 'SELECT *, round(close * (1 + CAST(vol AS BIGINT) % 7 / 100.0), 4) AS price_open, round(signal')}, {_DATES}, {_leg('o', 's DESC', price_in='price_open')} SELECT {_BT.format('gross', 'turnover', 'fee')} FROM bto")
def open_to_close_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bought at one price column and valued at another."""
    df = scored(spark, sf_dir).withColumn("price_open", F.round(F.col("close") * (1 + F.col("vol").cast("long") % 7 / 100), 4))
    return _r(P.backtest(df, 4, price_in="price_open"))


@query(f"WITH {PM}, {SC}, {_DATES}, {_leg('s', 's')} SELECT {_BT.format('-gross', 'turnover', 'fee')} FROM bts")
def short_leg_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(P.backtest(scored(spark, sf_dir), 4, side=-1))


@query(f"WITH {PM}, {SC}, {_DATES}, {_leg('l', 's DESC')}, {_leg('s', 's', 3, 'place <= n - 4')} SELECT {_BT.format('l.gross - s.gross', 'l.turnover + s.turnover', 'l.fee + s.fee')} FROM btl l JOIN bts s USING (trade_date, exit_date)")
def long_short_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(P.backtest(scored(spark, sf_dir), 4, short_k=3))


_BUF = f"""{PM}, {SC}, rk AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY s DESC, symbol) AS place FROM sc),
nm AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i, names FROM (SELECT trade_date, list(symbol ORDER BY place) AS names FROM rk WHERE place <= 6 GROUP BY 1)),
f AS (SELECT i, trade_date, names[:4] AS held FROM nm WHERE i = 1
  UNION ALL SELECT i, trade_date, list_concat(pool, list_filter(names, lambda z: NOT list_contains(pool, z)))[:4] FROM (
    SELECT i, trade_date, names, list_concat(kept, list_filter(names[:3], lambda z: NOT list_contains(kept, z))) AS pool FROM (
      SELECT nm.i, nm.trade_date, nm.names, list_filter(nm.names, lambda z: list_contains(f.held, z)) AS kept FROM f JOIN nm ON nm.i = f.i + 1)))"""


@query(f"WITH RECURSIVE {_BUF} SELECT trade_date, unnest(held) AS symbol FROM f")
def buffered_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.buffered(scored(spark, sf_dir), 4, exit_=2, entry=1).select("trade_date", "symbol")


_BUFCAP = f"""{PM}, {SC}, rk AS (SELECT *, CAST(symbol AS BIGINT) % 3 AS g, row_number() OVER (PARTITION BY trade_date ORDER BY s DESC, symbol) AS place FROM sc), rg AS (SELECT *, row_number() OVER (PARTITION BY trade_date, g ORDER BY place) AS gp FROM rk), rc AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY gp > 2, place) AS cp FROM rg),
nm AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i, names, first FROM (SELECT trade_date, list({{'symbol': symbol, 'g': g}} ORDER BY place) FILTER (place <= 7) AS names, list({{'symbol': symbol, 'g': g}} ORDER BY place) FILTER (gp <= 2 AND cp <= 5) AS first FROM rc GROUP BY 1)),
f AS (SELECT i, trade_date, first AS held FROM nm WHERE i = 1
  UNION ALL SELECT i, trade_date, list_reduce(list_prepend([{{'symbol': '', 'g': -1::BIGINT}}], list_transform(wanted, lambda x: [x])), lambda a, x: CASE WHEN len(a) <= 5 AND len(list_filter(a, lambda y: y.g = x[1].g)) < 2 THEN list_concat(a, x) ELSE a END)[2:] FROM (
    SELECT i, trade_date, CASE WHEN len(kept) >= 5 THEN kept ELSE list_concat(pool, list_filter(names, lambda z: NOT list_contains(pool, z)))[:5] END AS wanted FROM (
      SELECT i, trade_date, names, kept, list_concat(kept, list_filter(names[:4], lambda z: NOT list_contains(kept, z))) AS pool FROM (
        SELECT nm.i, nm.trade_date, nm.names, list_filter(nm.names, lambda z: list_contains(f.held, z)) AS kept FROM f JOIN nm ON nm.i = f.i + 1))))"""


@query(f"WITH RECURSIVE {_BUFCAP} SELECT trade_date, unnest(held).symbol AS symbol FROM f")
def capped_buffered_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five names, two of a group at most, with a band of two beyond the last place and one before it: cap and band often conflict."""
    df = scored(spark, sf_dir).withColumn("g", F.col("symbol").cast("long") % 3)
    return P.buffered(df, 5, exit_=2, entry=1, c=P.Constraints(group="g", most_of_group=2)).select("trade_date", "symbol")


@query(f"WITH RECURSIVE {PM}, {SC}, {_DATES}, {_leg('l', 's DESC', 4, exit_=2, entry=1)}, {_leg('s', 's', 3, 'place <= n - 4', 2, 1)} SELECT {_BT.format('l.gross - s.gross', 'l.turnover + s.turnover', 'l.fee + s.fee')} FROM btl l JOIN bts s USING (trade_date, exit_date)")
def buffered_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(P.backtest(scored(spark, sf_dir), 4, short_k=3, exit_=2, entry=1))


for _policy, _cond, _pick in (("ffill", "<= h.exit_date", "max_by"), ("delay", ">= h.exit_date", "min_by")):

    def _exit(spark: SparkSession, sf_dir: str, policy: str = _policy) -> DataFrame:
        p = weekly(spark, sf_dir)
        held = P.select(p.withColumn("s", F.col("amount")), 3).select("trade_date", "symbol").withColumn("exit_date", F.date_add("trade_date", 14))
        made = P.exits(held, p.withColumn("ok", F.col("vol").cast("long") % 2 == 0), policy, "ok")
        return made.select("trade_date", "symbol", "exit_price")

    _exit.__name__ = f"exit_policy_{_policy}"
    _one = f"(SELECT {_pick}(p.close, p.trade_date) FROM ok p WHERE p.symbol = h.symbol AND p.trade_date {_cond})"
    _back = "(SELECT max_by(p.close, p.trade_date) FROM ok p WHERE p.symbol = h.symbol AND p.trade_date <= h.exit_date)"
    query(f"WITH {PW}, ok AS (SELECT * FROM pw WHERE CAST(vol AS BIGINT) % 2 = 0), h AS (SELECT trade_date, symbol, trade_date + 14 AS exit_date FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, symbol) AS k FROM pw) WHERE k <= 3) SELECT trade_date, symbol, coalesce({_one}, {_back}) AS exit_price FROM h")(_exit)


@query(f"WITH {_PRICED} SELECT trade_date, round(CASE WHEN initial THEN moved * 15e-4 ELSE moved / 2 * 25e-4 END, 8) AS fee FROM tu")
def side_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    bt = P.backtest(scored(spark, sf_dir), 4)
    first = F.col("trade_date") == F.min("trade_date").over(Window.partitionBy(F.lit(0)))
    return bt.select("trade_date", F.round(P.side_fee(F.col("turnover"), first, 15, 10), 8).alias("fee"))


@query(f"WITH {PM} SELECT trade_date, symbol, round(0.01 * (2 + 8 * pow(least(0.01 * 1e6 / nullif(amount, 0), 1), 0.5)) / 1e4, 10) AS slippage FROM pm")
def participation_slippage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(spark, sf_dir).select("trade_date", "symbol", F.round(P.participation_slippage(F.lit(0.01), 1e6, F.col("amount"), 2, 8), 10).alias("slippage"))


_CAP = f"{PM}, adv AS (SELECT *, quantile_cont(amount, 0.5) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS med FROM pm), cp AS (SELECT *, CASE WHEN vol > 200 THEN coalesce(0.05 * least(med, amount) / 1e6, 0) ELSE 0 END AS capacity FROM adv WHERE med IS NOT NULL)"


def _capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.timeseries import lagged_median

    p = monthly(spark, sf_dir).withColumn("med", lagged_median("amount", 4)).withColumn("ok", F.col("vol") > 200).filter("med is not null")
    return P.capacity(p, ["med", "amount"], 0.05, 1e6, "ok")


@query(f"WITH {_CAP} SELECT trade_date, symbol, floor(capacity * 1e8 + 0.5001) / 1e8 AS capacity FROM cp")
def trade_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _capacity(spark, sf_dir).select("trade_date", "symbol", (F.floor(F.col("capacity") * 1e8 + 0.5001) / 1e8).alias("capacity"))


_ORD = f"{_CAP}, o AS (SELECT CAST(symbol AS BIGINT) AS order_id, symbol, 0.05 AS requested, DATE '1997-01-01' AS start, DATE '1997-12-01' AS stop FROM (SELECT DISTINCT symbol FROM cp))"


@query(f"""WITH {_ORD}, m AS (SELECT order_id, trade_date, requested, capacity, least(sum(capacity) OVER (PARTITION BY order_id ORDER BY trade_date), requested) AS done FROM o JOIN cp USING (symbol) WHERE trade_date BETWEEN start AND stop)
SELECT order_id, trade_date, round(done - coalesce(lag(done) OVER (PARTITION BY order_id ORDER BY trade_date), 0), 8) AS filled, round(requested - done, 8) AS "left" FROM m""")
def sell_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _capacity(spark, sf_dir)
    orders = days.select("symbol").distinct().select(F.col("symbol").cast("long").alias("order_id"), "symbol", F.lit(0.05).alias("requested"), F.lit("1997-01-01").cast("date").alias("start"), F.lit("1997-12-01").cast("date").alias("stop"))
    return P.sell_fills(orders, days).select("order_id", "trade_date", F.round("filled", 8).alias("filled"), F.round("left", 8).alias("left"))


@query(None)
def buy_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rebalance date orders its top-k portfolio, at most k rows, so that a date's fold stays small."""
    held = P.weights(P.select(scored(spark, sf_dir), 4))
    orders = held.select(F.col("trade_date").alias("rebalance_date"), F.col("symbol").cast("long").alias("order_id"), "symbol", F.col("weight").alias("requested"), F.col("trade_date").alias("start"))
    return P.buy_fills(orders, _capacity(spark, sf_dir), cash=0.2).select("rebalance_date", "order_id", "trade_date", F.round("filled", 8).alias("filled"))


_NAV = f"{IX}, nv AS (SELECT *, exp(sum(ln(1 + r)) OVER (ORDER BY trade_date)) AS nav FROM ix), dw AS (SELECT *, greatest(max(nav) OVER (ORDER BY trade_date), 1) AS peak FROM nv), dn AS (SELECT *, CASE WHEN nav >= peak THEN 0 ELSE nav / peak - 1 END AS drawdown FROM dw)"


@query(f"WITH {_NAV} SELECT trade_date, round(nav, 5) AS nav, round(drawdown, 6) AS drawdown FROM dn")
def nav_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(T.nav(index_series(spark, sf_dir)).select("trade_date", "nav", "drawdown"), nav=5)


@query(f"""WITH {_NAV}, i AS (SELECT *, sum(CASE WHEN drawdown >= 0 THEN 1 ELSE 0 END) OVER (ORDER BY trade_date) AS id FROM dn)
SELECT min(trade_date) AS start, arg_min(trade_date, (drawdown, trade_date)) AS trough, max(trade_date) AS last, round(min(drawdown), 6) AS depth, count(*) AS periods FROM i WHERE drawdown < 0 GROUP BY id ORDER BY min(drawdown), 1 LIMIT 10""")
def drawdown_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(T.episodes(index_series(spark, sf_dir)))


# the running maximum of the path itself; products of the same factors in the same order, so that equal levels are equal numbers
_PATH = f"""{IX}, lg AS (SELECT *, row_number() OVER (ORDER BY trade_date) AS position, CAST(r AS DOUBLE) AS rd FROM ix),
nv AS (SELECT position, trade_date, rd, 1 + rd AS nav FROM lg WHERE position = 1 UNION ALL SELECT lg.position, lg.trade_date, lg.rd, nv.nav * (1 + lg.rd) FROM nv JOIN lg ON lg.position = nv.position + 1),
pk AS (SELECT *, max(nav) OVER (ORDER BY position) AS peak FROM nv), dn AS (SELECT *, CASE WHEN nav >= peak THEN 0.0 ELSE nav / peak - 1 END AS drawdown FROM pk),
lo AS (SELECT * FROM dn ORDER BY drawdown, position LIMIT 1),
tp AS (SELECT max(dn.position) AS tp FROM dn, lo WHERE dn.position <= lo.position AND dn.nav = lo.peak), bk AS (SELECT min(dn.position) AS bk FROM dn, lo WHERE dn.position >= lo.position AND dn.nav >= lo.peak),
tm AS (SELECT (SELECT trade_date FROM dn WHERE position = tp) AS peak_date, lo.trade_date AS trough_date, (SELECT trade_date FROM dn WHERE position = bk) AS recovery_date, lo.drawdown AS depth, CAST(lo.position - tp AS DOUBLE) AS drawdown_duration, CAST(bk - lo.position AS DOUBLE) AS recovery_time FROM lo, tp, bk),
tmd AS (SELECT *, CAST(trough_date - peak_date AS DOUBLE) AS drawdown_duration_days, CAST(recovery_date - trough_date AS DOUBLE) AS recovery_time_days FROM tm)"""


@query(f"WITH RECURSIVE {_PATH} SELECT peak_date, trough_date, recovery_date, round(depth, 6) AS depth, drawdown_duration, recovery_time, drawdown_duration_days, recovery_time_days FROM tmd")
def drawdown_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(T.drawdown_timing(index_series(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_PATH}, a AS (SELECT count(*) AS periods, exp(sum(ln(1 + r))) - 1 AS total_return, avg(r) AS m, stddev_samp(r) AS s, sqrt(avg(least(r, 0) * least(r, 0))) AS dv, skewness(r) AS skew, kurtosis(r) AS kurtosis, quantile_cont(r, 0.05) AS var_95,
avg(exit_idx - entry_idx) AS avg_holding, arg_max(exit_idx, trade_date) - arg_min(entry_idx, trade_date) AS days, avg(greatest(exit_idx - planned_exit_idx, 0)) AS avg_exit_lag_days, CAST(max(greatest(exit_idx - planned_exit_idx, 0)) AS DOUBLE) AS max_exit_lag_days, count(CASE WHEN exit_idx > planned_exit_idx THEN 1 END) AS late FROM ix),
b AS (SELECT *, 52 / avg_holding AS y, (SELECT min(drawdown) FROM dn) AS mdd, (SELECT avg(r) FROM ix WHERE r <= var_95) AS cvar_95 FROM a)
SELECT periods, round(total_return, 4) AS total_return, round(pow(1 + total_return, 52.0 / days) - 1, 6) AS ann_return, round(s * sqrt(y), 6) AS ann_vol, round(m / s * sqrt(y), 5) AS sharpe, round(mdd, 6) AS max_drawdown, round(avg_holding, 6) AS avg_holding, round(y, 6) AS periods_per_year, round(m / dv * sqrt(y), 5) AS sortino,
round((pow(1 + total_return, 52.0 / days) - 1) / abs(mdd), 5) AS calmar, drawdown_duration, recovery_time, drawdown_duration_days, recovery_time_days, round(skew, 5) AS skew, round(kurtosis, 4) AS kurtosis, round(var_95, 6) AS var_95, round(cvar_95, 6) AS cvar_95,
round(avg_exit_lag_days, 6) AS avg_exit_lag_days, max_exit_lag_days, late AS periods_with_delayed_exit, round(late / periods, 6) AS delayed_exit_ratio FROM b, tmd""")
def return_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(T.summary(index_series(spark, sf_dir), 52), total_return=4, skew=5, kurtosis=4, sharpe=5, sortino=5, calmar=5)


@query(f"WITH {IX} SELECT CAST(date_trunc('year', trade_date) AS DATE) AS trade_date, round(exp(sum(ln(1 + r))) - 1, 6) AS r FROM ix GROUP BY 1")
def yearly_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(T.resampled(index_series(spark, sf_dir), "year"))


@query(f"""WITH {IX}, w AS (SELECT trade_date, count(r) OVER x AS c, avg(r) OVER x AS m, stddev_samp(r) OVER x AS d FROM ix WINDOW x AS (ORDER BY trade_date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT trade_date, round(CASE WHEN c >= 12 THEN m / nullif(d, 0) * sqrt(12) END, 5) AS sharpe FROM w""")
def rolling_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.signals import rolling

    return rolling(index_series(spark, sf_dir), "r", 12, 1, F.lit(12**0.5)).select("trade_date", F.round("ratio", 5).alias("sharpe"))


@query(f"WITH {IX} SELECT trade_date, round(CASE WHEN count(r) OVER x >= 12 THEN exp(sum(ln(1 + r)) OVER x) - 1 END, 5) AS cagr FROM ix WINDOW x AS (ORDER BY trade_date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def rolling_cagr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(T.rolling_cagr(index_series(spark, sf_dir), 12, 12), cagr=5)


@query(f"""WITH {IX}, n AS (SELECT trade_date, r, row_number() OVER (ORDER BY trade_date) AS i FROM ix),
w AS (SELECT a.trade_date, a.i AS hi, b.i, exp(sum(ln(1 + b.r)) OVER (PARTITION BY a.i ORDER BY b.i)) AS nav FROM n a JOIN n b ON b.i BETWEEN a.i - 11 AND a.i),
p AS (SELECT *, greatest(max(nav) OVER (PARTITION BY hi ORDER BY i), 1) AS peak FROM w)
SELECT trade_date, round(CASE WHEN hi >= 12 THEN least(min(nav / peak - 1), 0) END, 6) AS max_drawdown FROM p GROUP BY trade_date, hi""")
def rolling_max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(T.rolling_drawdown(index_series(spark, sf_dir), 12))


_BM = f"""{PM}, {SUP}, fr AS (SELECT trade_date, symbol, lead(close) OVER (PARTITION BY symbol ORDER BY trade_date) / nullif(close, 0) - 1 AS r FROM pm),
bm AS (SELECT trade_date, symbol, industry, r, cap / sum(cap) OVER (PARTITION BY trade_date) AS weight FROM fr JOIN sup USING (symbol) WHERE r IS NOT NULL AND cap > 0),
bs AS (SELECT trade_date, sum(weight * r) AS r, count(*) AS n, max(weight) AS top1, sum(weight * weight) AS hhi FROM bm GROUP BY 1)"""


def _members(spark: SparkSession, sf_dir: str, weighting: str = "cap") -> DataFrame:
    return B.members(monthly(spark, sf_dir), suppliers(spark, sf_dir), weighting)


@query(f"WITH {_BM} SELECT trade_date, round(r, 6) AS r, n, round(top1, 6) AS top1, round(hhi, 6) AS hhi, round(1 / hhi, 4) AS effective_n FROM bs")
def cap_weight_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(B.series(_members(spark, sf_dir)), effective_n=4)


@query(f"WITH {PM}, fr AS (SELECT trade_date, lead(close) OVER (PARTITION BY symbol ORDER BY trade_date) / nullif(close, 0) - 1 AS r FROM pm) SELECT trade_date, round(avg(r), 6) AS r, count(*) AS n FROM fr WHERE r IS NOT NULL GROUP BY 1")
def equal_weight_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(B.series(_members(spark, sf_dir, "equal")).select("trade_date", "r", "n"))


@query(f"""WITH {_BM}, c AS (SELECT industry, count(DISTINCT trade_date) AS periods, avg(weight) AS mw, quantile_cont(weight, 0.5) AS dw, sum(weight * r) AS contribution, count(CASE WHEN weight * r > 0 THEN 1 END) AS positive, count(CASE WHEN weight * r < 0 THEN 1 END) AS negative FROM bm GROUP BY 1)
SELECT industry, periods, round(mw, 6) AS mean_weight, round(dw, 6) AS median_weight, round(contribution, 5) AS contribution, positive, negative, round(contribution / sum(contribution) OVER (), 5) AS share FROM c""")
def contribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(B.contributions(_members(spark, sf_dir), "industry"), contribution=5, share=5)


@query(f"""WITH {_PRICED}, {_BM.replace(PM + ', ', '')}, b2 AS (SELECT rs.trade_date, rs.r AS a, bs.r AS b FROM rs JOIN bs USING (trade_date))
SELECT count(*) AS periods, round(covar_samp(a, b) / nullif(var_samp(b), 0), 5) AS beta, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) AS corr, round(exp(sum(ln(1 + a)) - sum(ln(1 + b))) - 1, 4) AS relative_return, round(stddev_samp(a - b) * sqrt(12), 6) AS tracking_error, round(avg(a - b) * sqrt(12) / nullif(stddev_samp(a - b), 0), 5) AS information_ratio, round((avg(a) - covar_samp(a, b) / nullif(var_samp(b), 0) * avg(b)) * 12, 5) AS alpha FROM b2""")
def active_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = T.active(_net(spark, sf_dir), B.series(_members(spark, sf_dir)), 12)
    return _r(made, beta=5, relative_return=4, information_ratio=5, alpha=5)


_EW = "ew AS (SELECT trade_date, avg(r) AS r FROM fr WHERE r IS NOT NULL GROUP BY 1)"


@query(f"""WITH {_PRICED}, {_BM.replace(PM + ', ', '')}, {_EW}, nm AS (SELECT unnest(['cap', 'equal', 'none']) AS benchmark), al AS (SELECT 'cap' AS benchmark, trade_date, r FROM bs UNION ALL SELECT 'equal', trade_date, r FROM ew),
b2 AS (SELECT benchmark, rs.r AS a, al.r AS b FROM rs JOIN al USING (trade_date)),
st AS (SELECT benchmark, count(*) AS periods, covar_samp(a, b) / nullif(var_samp(b), 0) AS beta, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS corr, exp(sum(ln(1 + a)) - sum(ln(1 + b))) - 1 AS relative_return, stddev_samp(a - b) * sqrt(12) AS tracking_error, avg(a - b) * sqrt(12) / nullif(stddev_samp(a - b), 0) AS information_ratio, (avg(a) - covar_samp(a, b) / nullif(var_samp(b), 0) * avg(b)) * 12 AS alpha FROM b2 GROUP BY 1)
SELECT benchmark, coalesce(periods, 0) AS periods, CASE WHEN benchmark = 'none' THEN 'missing' WHEN coalesce(periods, 0) < 2 THEN 'incompatible' ELSE 'ok' END AS status, round(beta, 5) AS beta, round(corr, 6) AS corr, round(relative_return, 4) AS relative_return, round(tracking_error, 6) AS tracking_error, round(information_ratio, 5) AS information_ratio, round(alpha, 5) AS alpha FROM nm LEFT JOIN st USING (benchmark)""")
def benchmark_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [B.series(_members(spark, sf_dir, w)).select(F.lit(w).alias("benchmark"), "trade_date", "r") for w in ("cap", "equal")]
    return _r(T.ladder(_net(spark, sf_dir), each[0].union(each[1]), 12, ["cap", "equal", "none"]), beta=5, relative_return=4, information_ratio=5, alpha=5)


@query(f"""WITH {IX}, {_BM}, w AS (SELECT ix.trade_date, ix.r, bs.r AS b, exp(sum(ln(1 + ix.r)) OVER (ORDER BY ix.trade_date)) AS nav, exp(sum(ln(1 + coalesce(bs.r, 0))) OVER (ORDER BY ix.trade_date)) AS bn, count(ix.r) OVER x AS c, avg(ix.r) OVER x / nullif(stddev_samp(ix.r) OVER x, 0) * sqrt(12) AS sh
FROM ix LEFT JOIN bs ON bs.trade_date = date_trunc('month', ix.trade_date) WINDOW x AS (ORDER BY ix.trade_date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)), p AS (SELECT *, greatest(max(nav) OVER (ORDER BY trade_date), 1) AS peak FROM w)
SELECT trade_date, r, round(nav, 5) AS nav, round(CASE WHEN nav >= peak THEN 0 ELSE nav / peak - 1 END, 6) AS drawdown, round(CASE WHEN b IS NOT NULL THEN ln(bn) END, 5) AS log_benchmark_nav, round(r - b, 6) AS active, round(CASE WHEN c >= 6 THEN sh END, 5) AS rolling_sharpe FROM p""")
def backtest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.series(_members(spark, sf_dir)).select(F.col("trade_date").alias("month"), "r")
    s = index_series(spark, sf_dir)
    dated = s.select("trade_date", F.trunc("trade_date", "MM").alias("month")).join(b, "month").select("trade_date", "r")
    made = T.report(s, dated, 6, 12).withColumn("log_benchmark_nav", F.log("benchmark_nav"))
    return _r(made.select("trade_date", "r", "nav", "drawdown", "log_benchmark_nav", "active", "rolling_sharpe"), r=8, nav=5, log_benchmark_nav=5, rolling_sharpe=5)


@query(f"""WITH {IX}, lp AS (SELECT lx.trade_date AS entry_date, lead(lx.trade_date) OVER (ORDER BY lx.trade_date) AS exit_date FROM lx WHERE trade_date = last)
SELECT entry_date, exit_date, round(b.close / nullif(a.close, 0) - 1, 6) AS r FROM lp JOIN lv a ON a.trade_date = entry_date JOIN lv b ON b.trade_date = exit_date""")
def benchmark_period_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = weekly(spark, sf_dir).groupBy("trade_date").agg(F.avg("close").alias("close"))
    ends = level.groupBy(F.trunc("trade_date", "MM")).agg(F.max("trade_date").alias("trade_date"))
    spans = P.periods(ends.select("trade_date")).withColumnRenamed("trade_date", "entry_date")
    return _r(T.benchmark_series(spans, prices=level))


@query(f"""WITH {_PRICED}, {_BM.replace(PM + ', ', '')}, ru AS (SELECT 'top4' AS run, bt.trade_date, gross - fee AS r, bs.r AS b, turnover FROM bt LEFT JOIN bs USING (trade_date)), nb AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY trade_date DESC) AS n FROM ru), w AS (SELECT CAST(unnest([6, 12]) AS INTEGER) AS "window")
SELECT run, "window", count(r) AS periods, round(avg(r), 6) AS mean, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(12), 5) AS sharpe, round(avg(r - b) / nullif(stddev_samp(r - b), 0) * sqrt(12), 5) AS information_ratio, round(avg(turnover), 6) AS turnover FROM nb JOIN w ON n <= "window" GROUP BY 1, 2""")
def run_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.series(_members(spark, sf_dir)).select("trade_date", F.col("r").alias("b"))
    runs = P.backtest(scored(spark, sf_dir), 4).select(F.lit("top4").alias("run"), "trade_date", F.col("net").alias("r"), "turnover").join(b, "trade_date", "left")
    return _r(T.last_periods(runs, [6, 12], 12), sharpe=5, information_ratio=5)


@query(f"""WITH {_SEL}, {SUP}, fr AS (SELECT trade_date, symbol, lead(close) OVER (PARTITION BY symbol ORDER BY trade_date) / nullif(close, 0) - 1 AS r FROM pm),
bm AS (SELECT trade_date, symbol, industry, cap / sum(cap) OVER (PARTITION BY trade_date) AS weight FROM fr JOIN sup USING (symbol) WHERE r IS NOT NULL AND cap > 0),
a AS (SELECT trade_date, coalesce(industry, 'unknown') AS industry, sum(w) AS portfolio FROM (SELECT trade_date, symbol, 1.0 / count(*) OVER (PARTITION BY trade_date) AS w FROM held) LEFT JOIN sup USING (symbol) GROUP BY 1, 2),
b AS (SELECT trade_date, coalesce(industry, 'unknown') AS industry, sum(weight) AS benchmark FROM bm GROUP BY 1, 2)
SELECT trade_date, industry, round(coalesce(portfolio, 0), 6) AS portfolio, round(coalesce(benchmark, 0), 6) AS benchmark, round(coalesce(portfolio, 0) - coalesce(benchmark, 0), 6) AS active FROM a FULL JOIN b USING (trade_date, industry)""")
def industry_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = P.weights(P.select(scored(spark, sf_dir), 4)).join(suppliers(spark, sf_dir), "symbol", "left")
    return _r(B.industry_exposure(held, _members(spark, sf_dir)))


@query(f"""WITH {_SEL}, z AS (SELECT trade_date, symbol, (ln(amount) - avg(ln(amount)) OVER d) / nullif(stddev_pop(ln(amount)) OVER d, 0) AS z, count(*) OVER d AS n FROM sc WINDOW d AS (PARTITION BY trade_date)), z2 AS (SELECT trade_date, symbol, CASE WHEN n >= 2 THEN z END AS z FROM z),
e AS (SELECT trade_date, avg(z) AS eq FROM z2 GROUP BY 1), m AS (SELECT held.trade_date, avg(z) AS po FROM held JOIN z2 USING (trade_date, symbol) WHERE z IS NOT NULL GROUP BY 1)
SELECT trade_date, round(po, 6) AS portfolio, round(po - eq, 6) AS active FROM m JOIN e USING (trade_date)""")
def style_exposure_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    made = B.style_exposure(P.weights(P.select(df, 4)), df.withColumn("size", X.safe_log("amount")), "size")
    return _r(made.select("trade_date", "portfolio", "active"))


@query(f"WITH {PM}, l AS (SELECT * FROM pm WHERE trade_date = (SELECT max(trade_date) FROM pm)) SELECT symbol, CAST(coalesce(floor(1e6 * (1 - 50 / 1e4) / count(*) OVER () / nullif(close * 10, 0)), 0) AS BIGINT) AS lots, round(coalesce(floor(1e6 * (1 - 50 / 1e4) / count(*) OVER () / nullif(close * 10, 0)), 0) * 10 * close, 4) AS value FROM l")
def lot_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = monthly(spark, sf_dir)
    last = p.join(F.broadcast(p.agg(F.max("trade_date").alias("trade_date"))), "trade_date")
    sized = last.join(F.broadcast(last.agg(F.count(F.lit(1)).alias("_n"))))
    made = P.lots(sized.select("symbol", (1 / F.col("_n")).alias("weight"), F.col("close").alias("price"), F.lit(10).alias("lot")), 1e6, 50)
    return made.select("symbol", "lots", F.round("value", 4).alias("value"))


@query(f"""WITH {PM}, v AS (SELECT symbol, trade_date, CASE WHEN count(close) OVER w >= 12 THEN len(list_filter(list(close) OVER w, lambda y: y <= close)) / 12.0 END AS pct, CASE WHEN count(close) OVER w >= 12 THEN (ln(close) - avg(ln(close)) OVER w) / nullif(stddev_samp(ln(close)) OVER w, 0) END AS z FROM pm WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT trade_date, symbol, CASE WHEN pct IS NULL OR z IS NULL THEN 'NA' WHEN pct >= 0.99 OR z >= 2.5 THEN 'EXTREME' WHEN pct >= 0.95 OR z >= 1.5 THEN 'HIGH' WHEN pct <= 0.2 AND z <= -0.5 THEN 'LOW' ELSE 'NEUTRAL' END AS class FROM v""")
def valuation_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.timeseries import value_percentile, value_zscore

    v = monthly(spark, sf_dir).withColumn("pct", value_percentile("close", 12)).withColumn("z", value_zscore("close", 12))
    known = F.when(F.col("pct").isNull() | F.col("z").isNull(), "NA").when((F.col("pct") >= 0.99) | (F.col("z") >= 2.5), "EXTREME").when((F.col("pct") >= 0.95) | (F.col("z") >= 1.5), "HIGH").when((F.col("pct") <= 0.2) & (F.col("z") <= -0.5), "LOW")
    return v.select("trade_date", "symbol", known.otherwise("NEUTRAL").alias("class"))


def _grid_sql() -> str:
    parts, rows = [], []
    for i, (k, bps) in enumerate(((3, 0), (3, 10), (5, 0), (5, 10))):
        parts.append(_leg(f"g{i}", "s DESC", k))
        fee = f"CASE WHEN initial THEN {bps / 1e4} ELSE moved * {bps / 1e4} END"
        rows.append(f"SELECT 'k{k}_equal_bps{bps}_x0_e0' AS variant, count(*) AS periods, round(avg(gross), 6) AS gross, round(avg(CASE WHEN initial THEN moved ELSE moved / 2 END), 6) AS turnover, round(avg({fee}), 6) AS fee, round(avg(gross - {fee}), 6) AS net, round(product(1 + gross - {fee}) / (1 + product(1 + gross - {fee})), 6) AS final_share FROM grg{i} JOIN tug{i} USING (trade_date)")
    return f"WITH {PM}, {SC}, {_DATES}, {', '.join(parts)} {' UNION ALL '.join(rows)}"


@query(_grid_sql())
def parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """final_share: a variant's final value over itself and the first one, so that long series stay comparable."""
    made = P.grid(scored(spark, sf_dir), [P.Variant(k, b) for k in (3, 5) for b in (0.0, 10.0)])
    return _r(made.withColumn("final_share", (1 + F.col("total_return")) / (2 + F.col("total_return"))).drop("total_return"))


@query(f"SELECT variant, periods, net FROM ({_grid_sql()}) ORDER BY net DESC, variant LIMIT 1")
def tuned_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of a search space by its mean net return; the report has one row."""
    made = _r(P.grid(scored(spark, sf_dir), P.trials({"k": (3, 5), "bps": (0.0, 10.0)})))
    return made.orderBy(F.desc("net"), "variant").limit(1).select("variant", "periods", "net")


def _construction_sql() -> str:
    parts, rows = [], []
    for i, (k, w, (x, e)) in enumerate((k, w, b) for k in (3, 5) for w in ("equal", "signal") for b in ((0, 0), (2, 1))):
        parts.append(_leg(f"c{i}", "s DESC", k, "TRUE", x, e, w == "signal"))
        rows.append(f"SELECT 'k{k}_{w}_bps10_x{x}_e{e}' AS variant, count(*) AS periods, round(avg(gross), 6) AS gross, round(avg(turnover), 6) AS turnover, round(avg(fee), 6) AS fee, round(avg(gross - fee), 6) AS net FROM btc{i}")
    return f"WITH RECURSIVE {PM}, {SC}, {_DATES}, {', '.join(parts)} {' UNION ALL '.join(rows)}"


@query(_construction_sql())
def construction_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, weighting and hysteresis crossed over one ranking of one scored panel."""
    variants = [P.Variant(k, 10.0, w, x, e) for k in (3, 5) for w in ("equal", "signal") for x, e in ((0, 0), (2, 1))]
    return _r(P.grid(scored(spark, sf_dir), variants).drop("total_return"))


@query("WITH x AS (SELECT CAST(o_custkey AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS entry_date, o_totalprice AS weight, o_orderkey FROM orders WHERE o_orderdate IS NOT NULL), m AS (SELECT max(entry_date) AS entry_date FROM x WHERE entry_date <= DATE '1997-06-30') SELECT entry_date, symbol, weight, row_number() OVER (ORDER BY weight DESC, symbol, o_orderkey) AS place FROM x JOIN m USING (entry_date)")
def latest_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("symbol"), F.col("o_orderdate").cast("date").alias("entry_date"), F.col("o_totalprice").alias("weight"), "o_orderkey").filter("entry_date is not null")
    held = P.holdings_at(o, "1997-06-30")
    return held.select("entry_date", "symbol", "weight", F.row_number().over(Window.orderBy(F.desc("weight"), "symbol", "o_orderkey")).cast("long").alias("place"))  # one date's holdings
