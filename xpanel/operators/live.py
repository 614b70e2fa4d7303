"""Live allocation: round lots, latest prices, sell signals, scenarios, export checks, order summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import bins


def round_lots(df: DataFrame, by: str, lot: str, order: str) -> DataFrame:
    """The most frequent lot of each `by`; of equally frequent ones the last by `order`. Null and not-a-number lots do not count."""
    value = F.col(lot).cast("double")
    counted = df.filter(value.isNotNull() & ~F.isnan(value)).groupBy(by, value.alias(lot)).agg(F.count(F.lit(1)).alias("_n"), F.max(order).alias("_at"))
    return counted.groupBy(by).agg(F.max_by(lot, F.struct("_n", "_at")).alias(lot))


def latest_prices(closes: DataFrame, snapshots: DataFrame, minutes: DataFrame, by: str = "symbol") -> DataFrame:
    """by, price, price_source: a positive snapshot, else a positive last minute, else the daily close. Each table has one row for each `by`."""
    named = [d.select(by, F.col("price").cast("double").alias(n)) for d, n in ((closes, "_close"), (snapshots, "_snapshot"), (minutes, "_minute"))]
    all_ = named[0].join(named[1], by, "left").join(named[2], by, "left")
    live = lambda c: (F.col(c) > 0) & ~F.isnan(c)
    pick = lambda a, b, c: F.when(live("_snapshot"), a).when(live("_minute"), b).otherwise(c)
    return all_.select(by, pick(F.col("_snapshot"), F.col("_minute"), F.col("_close")).alias("price"), pick(F.lit("snapshot"), F.lit("1m_close"), F.lit("1d_close")).alias("price_source"))


def sell_signals(prices: DataFrame, window: int, high: float, extreme: float, price: str = "close") -> DataFrame:
    """For each symbol: as_of (the table's last date), its price then, the triggers and the last date of a crossing.

    A trigger is the row before's quantile over `window` rows, null until there are so many prices. A crossing is a price at or
    above the trigger after one below it. A symbol without a row on the last date has null price and triggers.
    """
    w = Window.partitionBy("symbol").orderBy("trade_date")
    span = w.rowsBetween(1 - window, 0)
    full = F.count(price).over(span) >= window
    lines = prices.select("symbol", "trade_date", F.col(price).alias("close"), *(F.when(full, F.percentile(price, q).over(span)).alias(n) for q, n in ((high, "_high"), (extreme, "_extreme"))))
    lines = lines.withColumns({"sell_trigger": F.lag("_high").over(w), "extreme_trigger": F.lag("_extreme").over(w), "_before": F.lag("close").over(w)})
    crossed = (F.col("close") >= F.col("sell_trigger")) & (F.col("_before") < F.col("sell_trigger"))
    last = prices.agg(F.max("trade_date").alias("as_of"))  # one row
    now = F.col("trade_date") == F.col("as_of")
    return lines.crossJoin(F.broadcast(last)).groupBy("symbol", "as_of").agg(*(F.max(F.when(now, F.col(c))).alias(c) for c in ("close", "sell_trigger", "extreme_trigger")), F.max(F.when(crossed, F.col("trade_date"))).alias("last_sell_signal_date"))


def scenarios(ranked: DataFrame, capitals: Sequence[float], tops: Sequence[int], lot: int = 1) -> DataFrame:
    """capital, top_n, symbol, lots: equal-weight whole lots of every pair of parameters; the grid is the broadcast side. ranked: symbol, place, price."""
    grid = ranked.sparkSession.createDataFrame([(float(c), int(n)) for c in capitals for n in tops], "capital double, top_n int")
    both = ranked.join(F.broadcast(grid), F.col("place") <= F.col("top_n"))
    sized = F.floor(F.try_divide(F.try_divide(F.col("capital"), F.col("top_n")), F.col("price") * lot))
    return both.select("capital", "top_n", "symbol", F.coalesce(sized, F.lit(0)).cast("long").alias("lots"))


def targets(held: DataFrame, slack: float = 1e-8) -> DataFrame:
    """symbol, target_weight of long-only holdings. Fails on other sides, weights that are not finite or negative, a sum that is not in (0, 1], repeated symbols."""
    weight = F.col("weight").cast("double")
    finite = weight.isNotNull() & ~F.isnan(weight) & (F.abs(weight) != float("inf"))
    long = F.lower(F.coalesce(F.col("side"), F.lit(""))) == "long" if "side" in held.columns else F.lit(True)
    named = held.select(F.trim(F.col("symbol").cast("string")).alias("symbol"), weight.alias("target_weight"), (finite & (weight >= 0) & long).alias("_fit"))
    once = named.groupBy("symbol").agg(F.first("target_weight").alias("target_weight"), F.sum("target_weight").alias("_w"), F.bool_and("_fit").alias("_fit"), F.count(F.lit(1)).alias("_n"))
    whole = once.agg(F.sum("_w").alias("_sum"), F.bool_and("_fit").alias("_all"), F.max("_n").alias("_most"))  # one row
    bad = ~F.col("_all") | (F.col("_most") > 1) | (F.col("_sum") <= 0) | (F.col("_sum") > 1 + slack)
    checked = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("holdings are not valid targets")).cast("double")).otherwise(F.col("target_weight"))
    return once.crossJoin(F.broadcast(whole)).select("symbol", checked.alias("target_weight"))


def order_summary(orders: DataFrame) -> DataFrame:
    """One row of totals and fill ratios over orders: side, status, requested_notional, filled_notional, unfilled_notional."""
    total = lambda c, side=None: F.coalesce(F.sum(F.when(F.col("side") == side, F.col(c)) if side else F.col(c)), F.lit(0.0))
    ratio = lambda side=None: F.when(total("requested_notional", side) > 0, total("filled_notional", side) / total("requested_notional", side))
    many = lambda side, status: F.count_if((F.col("side") == side) & (F.col("status") == status))
    return orders.agg(
        F.count(F.lit(1)).alias("orders"),
        *(total(c).alias(c) for c in ("requested_notional", "filled_notional", "unfilled_notional")),
        ratio().alias("fill_ratio"),
        *(ratio(s).alias(f"{s}_fill_ratio") for s in ("buy", "sell")),
        *(total("unfilled_notional", s).alias(f"unfilled_{s}_notional") for s in ("buy", "sell")),
        many("buy", "abandoned_zero_fill").alias("abandoned_buy_orders"),
        many("sell", "delayed_sell").alias("delayed_sell_orders"),
    )


# The order in which valuation classes are filled; any other class comes last.
VALUATION_ORDER = {"LOW": 0, "NEUTRAL": 1, "HIGH": 2, "EXTREME": 3, "NA": 4}


@dataclass(frozen=True)
class Filling:
    """How left-over cash is spent. steps: the most lots of a scenario; None: any number. most_over: the value by which a last lot may pass its target; None: never. calm_first, calm_only: names of high or extreme valuation come last, or not at all."""

    steps: int | None = 1000
    buffer_share: float = 0.0
    buffer: float = 0.0
    fee: float = 0.0
    most_over: float | None = None
    calm_first: bool = False
    calm_only: bool = False


def secondary_fill(allocation: DataFrame, rule: Filling = Filling()) -> DataFrame:  # noqa: B008
    """scenario, symbol, lots, extra, gap, cash_left: what is left of a scenario's capital goes to further lots.

    allocation: scenario, capital, symbol, price, round_lot, lots, target_value, valuation, tradable; the same each time it is computed.
    A lot must bring its name nearer to the target. Names rank by valuation class, then the gap that a lot leaves, its cost and symbol.
    Every further lot leaves its own name a smaller gap, so a name that comes first stays first until it is done: names are served in the
    order of their first lot, each as many whole lots as it wants and as the cash that the names before it have left will pay. The wants
    are expressions of a row; the cash is followed in `_rounds`, of which a scenario has a few.
    """
    zero, fee = F.lit(0.0), max(rule.fee, 0.0)
    cost = F.when(F.col("tradable") & (F.col("price") > 0) & (F.col("round_lot") > 0), F.col("price") * F.col("round_lot")).otherwise(zero)
    spent = F.col("lots") * F.coalesce("round_lot", zero) * F.coalesce("price", zero)
    rows = allocation.withColumns({"_cost": F.coalesce(cost, zero), "_spent": spent}).withColumn("_gap", F.coalesce("target_value", zero) - F.col("_spent"))
    below = F.floor(F.try_divide("_gap", "_cost") + 1e-12)  # whole lots that stay at or below the target
    rest = F.col("_gap") - below * F.col("_cost")
    over = F.lit(0) if rule.most_over is None else ((rest > 1e-9) & (F.col("_cost") - rest < rest - 1e-9) & (F.col("_cost") - rest <= rule.most_over + 1e-9)).cast("int")
    wanted = F.when((F.col("_cost") > 0) & (F.col("_gap") > 1e-9), below + over).otherwise(0).cast("long")
    high = F.coalesce(F.col("valuation").isin("HIGH", "EXTREME"), F.lit(False))
    if rule.calm_only:
        wanted = F.when(high, 0).otherwise(wanted)
    place = F.coalesce(*(F.when(F.col("valuation") == n, i) for n, i in VALUATION_ORDER.items()), F.lit(len(VALUATION_ORDER)))
    copies = Window.partitionBy("scenario", "symbol").orderBy(place, "_gap", "_cost", "_wanted", "lots")  # rows of one name, if there are several
    key = F.struct((high & F.lit(rule.calm_first)).alias("high"), place.alias("place"), F.abs(F.col("_gap") - F.col("_cost")).alias("after"), F.col("_cost").alias("cost"), "symbol", F.row_number().over(copies).alias("copy"))
    rows = rows.withColumns({"_wanted": F.coalesce(wanted, F.lit(0)).cast("long"), "_unit": F.col("_cost") + fee}).withColumn("_key", key).select("scenario", "capital", "symbol", "lots", "_gap", "_cost", "_spent", "_key", "_wanted", "_unit")
    rows = rows.persist()
    try:
        rounds, left = _rounds(rows, rule)
    finally:
        rows.unpersist()
    after = F.col("_from").isNull() | (F.col("_key") > F.col("_from"))
    until = F.col("_to").isNull() | (F.col("_key") <= F.col("_to"))
    served = rows.join(F.broadcast(left), F.col("scenario").eqNullSafe(F.col("_at"))).drop("_at")  # a row for each scenario
    served = served.join(F.broadcast(rounds), F.col("scenario").eqNullSafe(F.col("_of")) & (F.col("_wanted") > 0) & after & until, "left")  # a row for each round
    extra = F.coalesce(F.when(F.col("_key") == F.col("_to"), F.col("_last")).when(F.col("_unit") <= F.col("_small"), F.col("_wanted")), F.lit(0)).cast("long")
    served = served.withColumn("extra", extra)
    return served.select("scenario", "symbol", (F.col("lots") + F.col("extra")).cast("long").alias("lots"), "extra", (F.col("_gap") - F.col("extra") * F.col("_cost")).alias("gap"), "cash_left")


def _rounds(rows: DataFrame, rule: Filling) -> tuple[DataFrame, DataFrame]:
    """Rounds (_of, _from, _to, _small, _last) and the cash left of every scenario (_at, cash_left).

    A round begins after the name _from. Lots of up to _small (half the cash, or the largest lot) are small. While the cash is not below
    _small, every small lot can be paid, so a running sum says what cash each name meets. The round ends at the first name _to that
    gets a large lot, not all the small ones that it wants, the last step, or leaves less cash than _small; it gets _last lots. So a round
    halves the cash at least, and names are passed about as often as the logarithm of cash over the smallest lot. Running sums are of
    blocks of names (class and bin of the gap left) and of the blocks' totals; names of one gap share a block. One row for each scenario is
    collected.
    """
    spark, kind, shape = rows.sparkSession, *(rows.schema[c].dataType.simpleString() for c in ("scenario", "_key"))
    first = rows.groupBy("scenario").agg(F.max("capital").alias("capital"), F.sum("_spent").alias("spent"), F.max(F.when(F.col("_wanted") > 0, F.col("_unit"))).alias("most"))
    share, buffer = max(rule.buffer_share, 0.0), max(rule.buffer, 0.0)
    cash, going, made = {}, {}, []
    for r in first.select("scenario", (F.col("capital") - F.col("capital") * share - buffer - F.col("spent")).alias("cash"), "most").collect():
        cash[r.scenario] = r.cash
        if r.most is not None and r.cash is not None and not math.isnan(r.cash):
            going[r.scenario] = (None, r.most, 2**62 if rule.steps is None else rule.steps)
    asks = rows.filter("_wanted > 0").withColumn("_after", F.col("_key.after"))
    if going:
        asks = asks.withColumn("_block", F.struct("_key.high", "_key.place", bins(asks, "_after").alias("bin")))
    while going:
        state = [(s, at, float(cash[s]), float(min(cash[s] / 2, most)), steps) for s, (at, most, steps) in going.items()]
        now = spark.createDataFrame(state, f"_at {kind}, _from {shape}, _cash double, _small double, _steps long")
        open_ = (F.col("_unit") <= F.col("_cash") + 1e-9) & (F.col("_from").isNull() | (F.col("_key") > F.col("_from")))
        small = F.col("_unit") <= F.col("_small")
        named = asks.join(F.broadcast(now), F.col("scenario").eqNullSafe(F.col("_at")) & open_)
        named = named.withColumns({"_need": F.when(small, F.col("_wanted") * F.col("_unit")).otherwise(0.0), "_many": F.when(small, F.col("_wanted")).otherwise(0)})
        blocks, names = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (Window.partitionBy("_at").orderBy("_b"), Window.partitionBy("_at", "_block").orderBy("_key")))
        totals = named.groupBy("_at", F.col("_block").alias("_b")).agg(F.sum("_need").alias("_n"), F.sum("_many").alias("_m"))
        totals = totals.select(F.col("_at").alias("_s"), "_b", *(F.coalesce(F.sum(c).over(blocks), F.lit(0)).alias(c) for c in ("_n", "_m")))  # a row for each block
        met = named.withColumns({"_before": F.coalesce(F.sum("_need").over(names), F.lit(0.0)), "_taken": F.coalesce(F.sum("_many").over(names), F.lit(0))})
        met = met.join(F.broadcast(totals), F.col("_at").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
        met = met.withColumns({"_has": F.col("_cash") - F.col("_n") - F.col("_before"), "_steps": F.col("_steps") - F.col("_m") - F.col("_taken")})
        met = met.withColumn("_able", F.floor((F.col("_has") + 1e-9) / F.col("_unit")).cast("long"))
        met = met.withColumn("_last", F.greatest(F.least("_wanted", "_able", "_steps"), F.lit(0)).cast("long"))
        short = (F.col("_able") < F.col("_wanted")) | (F.col("_has") - F.col("_need") < F.col("_small")) | (F.col("_steps") <= F.col("_wanted"))
        end = F.struct("_key", "_last", (F.col("_has") - F.col("_last") * F.col("_unit")).alias("cash"), (F.col("_steps") - F.col("_last")).alias("steps"))
        ends = F.when(F.when(small, short).otherwise(F.col("_able") >= 1), end)
        found = {r.scenario: r for r in met.groupBy("scenario").agg(F.min(ends).alias("end"), F.sum("_need").alias("total")).collect()}
        for s, at, _, least, _ in state:
            got, [_, most, _] = found.get(s), going.pop(s)
            if got is None or got.end is None:
                made.append((s, at, None, least, 0))
                cash[s] -= got.total if got else 0.0
                continue
            made.append((s, at, got.end["_key"], least, got.end["_last"]))
            cash[s] = got.end.cash
            if got.end.steps > 0:
                going[s] = (got.end["_key"], most, got.end.steps)
    rounds = spark.createDataFrame(made, f"_of {kind}, _from {shape}, _to {shape}, _small double, _last long")
    return rounds, spark.createDataFrame([(s, None if c is None else float(c)) for s, c in cash.items()], f"_at {kind}, cash_left double")
