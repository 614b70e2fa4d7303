"""Capacity-limited execution of a series of target portfolios, as joins and running sums.

Orders are the differences of consecutive targets: every target is met with the one before by symbol in one grouping, so a name that
leaves the portfolio is sold and one that comes is bought. A sell stays open until the next entry, a buy for a number of trading
days. What an order has done by a day is the running sum of what could be traded, up to its request. Orders do not compete: cash is
not followed, and the next order starts from the target, not from what was left open (`unfilled` tells how much that is).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import dates as D

DONE = 1e-12
STATUSES = ("filled", "delayed_sell", "cancelled_buy_deadline", "abandoned_zero_fill")  # fixed values


def orders(targets: DataFrame, prices: DataFrame, buy_days: int = 5) -> DataFrame:
    """rebalance_date, symbol, side, requested (a weight), first and last (indices of the dates of prices, when it is open).

    targets: rebalance_date, entry_date, symbol, weight; rows with nulls fall out and repeated names add up. An entry that is no
    date of prices has no orders.
    """
    good = targets.filter("rebalance_date is not null and entry_date is not null and symbol is not null and weight is not null")
    cal = D.calendar(prices.filter("trade_date is not null"))  # a row for each date, as are the next two
    end = cal.agg(F.max("idx").alias("_end"))
    entries = good.groupBy("rebalance_date").agg(F.min("entry_date").alias("entry_date")).withColumn("_i", F.row_number().over(Window.orderBy("rebalance_date")))
    at = entries.join(cal.select(F.col("trade_date").alias("entry_date"), F.col("idx").alias("first")), "entry_date", "left")
    at = at.withColumn("_next", F.lead("first").over(Window.orderBy("_i"))).crossJoin(F.broadcast(end)).filter("first is not null")
    mine = good.join(F.broadcast(entries.select("rebalance_date", "_i")), "rebalance_date")
    now = mine.select("_i", "symbol", F.col("weight").alias("_now"), F.lit(0.0).alias("_before"))
    then = mine.select((F.col("_i") + 1).alias("_i"), "symbol", F.lit(0.0).alias("_now"), F.col("weight").alias("_before"))
    moved = now.unionByName(then).groupBy("_i", "symbol").agg((F.sum("_now") - F.sum("_before")).alias("_d")).filter(F.abs("_d") > DONE)
    sell = F.col("_d") < 0
    last = F.when(sell, F.greatest("first", F.coalesce(F.col("_next") - 1, F.col("_end")))).otherwise(F.least(F.col("first") + buy_days - 1, F.col("_end")))
    return moved.join(F.broadcast(at), "_i").select("rebalance_date", "symbol", F.when(sell, "sell").otherwise("buy").alias("side"), F.abs("_d").alias("requested"), "first", last.alias("last"))


def progress(placed: DataFrame, room: DataFrame, capitals: dict[str, float]) -> DataFrame:
    """Every day of every order for every capital: scenario, the order's columns, trade_date, day_number, capacity, fill_weight, remaining.

    room: trade_date, symbol, room, the notional that can be traded; missing or null counts as 0, repeated rows add up. An order
    meets only the days of its window, by symbol and day.
    """
    if any(c <= 0 for c in capitals.values()):
        raise ValueError("capitals must be above 0")
    table = placed.sparkSession.createDataFrame([(n, float(c)) for n, c in capitals.items()], "scenario string, capital double")
    cal = D.calendar(room.filter("trade_date is not null"))
    rooms = room.groupBy("trade_date", "symbol").agg(F.sum("room").alias("room")).join(F.broadcast(cal), "trade_date").select("symbol", "idx", "room")
    open_ = placed.withColumn("idx", F.explode(F.sequence("first", "last"))).join(rooms, ["symbol", "idx"], "left").join(F.broadcast(cal), "idx")
    met = open_.crossJoin(F.broadcast(table)).withColumn("capacity", F.coalesce("room", F.lit(0.0)) / F.col("capital"))
    order = Window.partitionBy("scenario", "rebalance_date", "symbol").orderBy("idx")
    done = F.least(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.col("requested"))
    before = F.least(F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), F.col("requested"))
    return met.select("scenario", "capital", "rebalance_date", "symbol", "side", "requested", "trade_date", (F.col("idx") - F.col("first") + 1).alias("day_number"), "capacity", (done - before).alias("fill_weight"), (F.col("requested") - done).alias("remaining"))


def fills(made: DataFrame) -> DataFrame:
    return made.filter(F.col("fill_weight") > DONE)


def closed(made: DataFrame) -> DataFrame:
    """One row for each order: what was filled, in how many days, and its status."""
    done = made.groupBy("scenario", "capital", "rebalance_date", "symbol", "side").agg(F.max("requested").alias("requested"), F.sum("fill_weight").alias("filled"), F.count_if(F.col("fill_weight") > DONE).alias("fill_days"))
    unfilled = F.greatest(F.col("requested") - F.col("filled"), F.lit(0.0))
    status = F.when(unfilled <= DONE, "filled").when(F.col("side") == "sell", "delayed_sell").when(F.col("filled") > DONE, "cancelled_buy_deadline").otherwise("abandoned_zero_fill")
    return done.withColumns({"unfilled": unfilled, "status": status})


def summarized(made: DataFrame, by: Sequence[str] = ("scenario",)) -> DataFrame:
    """Requested, filled and unfilled notional by side, and the number of orders of every status."""
    total = lambda c, side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col(c) * F.col("capital"))), F.lit(0.0))
    return made.groupBy(*by).agg(
        F.count(F.lit(1)).alias("orders"), *(total(c, s).alias(f"{c}_{s}_notional") for s in ("buy", "sell") for c in ("requested", "filled", "unfilled")),
        *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES),
    )
