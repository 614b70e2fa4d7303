"""Portfolio construction, periods, costs and capacity.

What depends only on one date is relational. What depends on the date before (hysteresis, cash) is a fold over one
row for each date, so its state is a portfolio's size and never the panel's.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from random import Random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import safe_div


@dataclass(frozen=True)
class Constraints:
    least_price: float = 0.0
    least_amount: float = 0.0
    tradable: str | None = None
    group: str | None = None
    most_of_group: int | None = None


def eligible(df: DataFrame, c: Constraints) -> DataFrame:
    """Rows that may be bought: a finite price, price, amount and tradability as asked."""
    ok = F.col("close").isNotNull() & ~F.isnan("close") & (F.abs("close") != float("inf")) & (F.col("close") >= c.least_price)
    if c.least_amount:
        ok = ok & (F.col("amount") >= c.least_amount)
    if c.tradable:
        ok = ok & F.coalesce(F.col(c.tradable), F.lit(False))
    return df.filter(ok)


def select(df: DataFrame, k: int, score: str = "s", c: Constraints = Constraints(), ascending: bool = False) -> DataFrame:  # noqa: B008
    """trade_date, symbol, place of the k best of each date, ties by symbol; a group's cap counts names that pass all else, a null group has none."""
    order = [F.asc(score) if ascending else F.desc(score), F.asc("symbol")]
    df = eligible(df, c).filter(F.col(score).isNotNull())
    if c.group and c.most_of_group:
        n = F.row_number().over(Window.partitionBy("trade_date", c.group).orderBy(*order))
        df = df.withColumn("_g", n).filter(F.col(c.group).isNull() | (F.col("_g") <= c.most_of_group)).drop("_g")
    return df.withColumn("place", F.row_number().over(Window.partitionBy("trade_date").orderBy(*order))).filter(F.col("place") <= k)


def weights(held: DataFrame, mode: str = "equal", score: str = "s", side: int = 1) -> DataFrame:
    """held with weight, summing to 1 on each date: equal, or exp of the clipped z-score of the signed score."""
    day = Window.partitionBy("trade_date")
    if mode == "equal":
        return held.withColumn("weight", 1 / F.count(F.lit(1)).over(day))
    if mode != "signal":
        raise ValueError(f"unknown weighting {mode!r}")
    x = F.col(score) * side
    z = F.coalesce(safe_div(x - F.avg(x).over(day), F.stddev_pop(x).over(day)), F.lit(0.0))
    return held.withColumn("_e", F.exp(F.greatest(F.lit(-5.0), F.least(z, F.lit(5.0))))).withColumn("weight", F.col("_e") / F.sum("_e").over(day)).drop("_e")


def held_names(ranked: DataFrame, k: Column, exit_: Column, entry: Column, by: Sequence[str] = (), most_of_group: int | None = None) -> DataFrame:
    """by, trade_date, symbol held with hysteresis, from names ranked within each date (by, trade_date, place, symbol, group if there is a cap).

    A held name stays a candidate while its place is within k + exit; names within k - entry come next, then the others, up to k candidates. With a
    cap, candidates are taken in that order while their group has room (a null group always has), so fewer than k may be held; without
    a date before, or without a band, the cap fills up from the whole ranking. One row for each date holds its first names, and a
    fold over the dates of each `by` carries the last holdings; the state is a portfolio, whatever the panel's size. Symbols are
    unique within a date.
    """
    by = list(by)
    group = F.col("group") if most_of_group is not None else F.lit(None).cast("string")
    capped = F.col("place")
    rows = ranked.withColumns({"_k": k, "_x": F.greatest(exit_, F.lit(0)), "_e": F.greatest(entry, F.lit(0)), "_g": group})
    if most_of_group is not None:
        inner = F.row_number().over(Window.partitionBy(*by, "trade_date", "_g").orderBy("place"))
        rows = rows.withColumn("_ok", F.col("_g").isNull() | (inner <= most_of_group))
        capped = F.when(F.col("_ok"), F.sum(F.col("_ok").cast("int")).over(Window.partitionBy(*by, "trade_date").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_first", F.coalesce(capped <= F.col("_k"), F.lit(False))).filter(F.col("_first") | (F.col("place") <= F.col("_k") + F.col("_x")))
    one = F.struct("place", "symbol", F.col("_g").alias("group"), "_first")
    names = rows.groupBy(*by, "trade_date", "_k", "_x", "_e").agg(F.sort_array(F.collect_list(one)).alias("names"))
    days = names.groupBy(*by, "_k", "_x", "_e").agg(F.sort_array(F.collect_list(F.struct("trade_date", "names"))).alias("days"))
    none = F.lit(None).cast("array<string>")
    start = F.struct(none.alias("held"), F.array().cast("array<struct<trade_date:date,held:array<string>>>").alias("out"))

    def step(s: Column, d: Column) -> Column:
        names = d["names"]
        near = F.filter(names, lambda n: n["place"] <= F.col("_k") + F.col("_x"))
        kept = F.filter(near, lambda n: F.array_contains(s["held"], n["symbol"]))
        pool = F.array_distinct(F.concat(kept, F.filter(near, lambda n: n["place"] <= F.col("_k") - F.col("_e")), near))
        wanted = F.when(F.size(kept) >= F.col("_k"), kept).otherwise(F.slice(pool, F.lit(1), F.col("_k")))
        if most_of_group is None:
            chosen = F.slice(wanted, F.lit(1), F.col("_k"))
        else:
            room = lambda a, n: (F.size(a) < F.col("_k")) & (n["group"].isNull() | (F.size(F.filter(a, lambda x: x["group"] == n["group"])) < most_of_group))
            chosen = F.aggregate(wanted, F.filter(wanted, lambda n: F.lit(False)), lambda a, n: F.when(room(a, n), F.array_append(a, n)).otherwise(a))
        fresh = s["held"].isNull() | ((F.col("_x") == 0) & (F.col("_e") == 0))
        held = F.transform(F.when(fresh, F.filter(names, lambda n: n["_first"])).otherwise(chosen), lambda n: n["symbol"])
        return F.struct(held.alias("held"), F.array_append(s["out"], F.struct(d["trade_date"].alias("trade_date"), held.alias("held"))).alias("out"))

    held = days.select(*by, F.explode(F.aggregate("days", start, step)["out"]).alias("_d"))
    return held.select(*by, "_d.trade_date", F.explode("_d.held").alias("symbol"))


def buffered(df: DataFrame, k: int, exit_: int, entry: int, score: str = "s", c: Constraints = Constraints()) -> DataFrame:  # noqa: B008
    """The rows of df held with hysteresis, with place; a group's cap holds together with the band (see held_names)."""
    capped = c.group and c.most_of_group
    if capped:
        order = [F.desc(score), F.asc("symbol")]
        ranked = eligible(df, c).filter(F.col(score).isNotNull()).withColumn("place", F.row_number().over(Window.partitionBy("trade_date").orderBy(*order)))
        names = ranked.select("trade_date", "place", "symbol", F.col(c.group).cast("string").alias("group"))
    else:
        ranked = select(df, k + max(0, exit_), score, c)
        names = ranked.select("trade_date", "place", "symbol")
    held = held_names(names, F.lit(k), F.lit(exit_), F.lit(entry), (), c.most_of_group if capped else None)
    return ranked.join(held, ["trade_date", "symbol"], "left_semi").select(ranked.columns)


def holdings_at(positions: DataFrame, as_of: str) -> DataFrame:
    """Rows of the latest entry_date at or before as_of; none if there is no such date."""
    known = positions.filter(F.col("entry_date") <= F.lit(as_of).cast("date"))
    return known.join(F.broadcast(known.agg(F.max("entry_date").alias("entry_date"))), "entry_date", "left_semi")  # one row


def periods(dates: DataFrame) -> DataFrame:
    """trade_date, exit_date: each rebalance and the next; the last has none and is left out."""
    return dates.select("trade_date").distinct().withColumn("exit_date", F.lead("trade_date").over(Window.orderBy("trade_date"))).filter("exit_date is not null")


def exits(held: DataFrame, prices: DataFrame, policy: str = "strict", tradable: str | None = None) -> DataFrame:
    """held (trade_date, exit_date, symbol) with exit_price.

    strict: the price on the exit date; ffill: the last one at or before it; delay: the first one at or after it, each
    name on its own, else the last before.
    """
    ok = F.col("close").isNotNull() & (F.coalesce(F.col(tradable), F.lit(False)) if tradable else F.lit(True))
    p = prices.filter(ok).select("symbol", F.col("trade_date").alias("_d"), "close")
    if policy == "strict":
        return held.join(p.withColumnRenamed("_d", "exit_date").withColumnRenamed("close", "exit_price"), ["symbol", "exit_date"], "left")
    from .joins import asof

    back = asof(held, p.select("symbol", F.col("_d").alias("exit_date"), F.col("close").alias("exit_price")), ["symbol"], "exit_date", ["exit_price"])
    if policy == "ffill":
        return back
    if policy != "delay":
        raise ValueError(f"unknown exit policy {policy!r}")
    # the first price at or after a date is the last one before it on a mirrored axis
    mirror = lambda c: F.datediff(F.lit("9999-01-01").cast("date"), c)
    right = p.select("symbol", mirror(F.col("_d")).alias("_m"), F.col("close").alias("_late"), F.col("_d").alias("delayed_to"))
    both = asof(back.withColumn("_m", mirror(F.col("exit_date"))), right, ["symbol"], "_m", ["_late", "delayed_to"])
    return both.withColumn("exit_price", F.coalesce("_late", "exit_price")).drop("_m", "_late")


def period_returns(held: DataFrame) -> DataFrame:
    """trade_date, exit_date, gross, n: weights renormalised over names with both prices."""
    ok = held.filter("entry_price is not null and exit_price is not null and entry_price <> 0")
    r = F.col("exit_price") / F.col("entry_price") - 1
    return ok.groupBy("trade_date", "exit_date").agg((F.sum(F.col("weight") * r) / F.sum("weight")).alias("gross"), F.count(F.lit(1)).alias("n"))


def bps_fee(turnover: Column, initial: Column, bps: float) -> Column:
    """One side at first, both sides of the turnover later."""
    return F.when(initial, F.lit(bps / 1e4)).otherwise(2 * turnover * bps / 1e4)


def side_fee(turnover: Column, initial: Column, buy_bps: float, sell_bps: float, short_share: float = 0.0, borrow_bps: float = 0.0, years: Column | None = None) -> Column:
    trade = F.when(initial, turnover * buy_bps / 1e4).otherwise(turnover * (buy_bps + sell_bps) / 1e4)
    return trade + (short_share * borrow_bps / 1e4 * (years if years is not None else F.lit(0.0)))


def participation_slippage(traded: Column, capital: float, amount: Column, base_bps: float, impact_bps: float, power: float = 0.5, cap: float = 1.0) -> Column:
    """base + impact * participation ^ power, in return units of the traded weight; participation at most cap."""
    part = F.least(safe_div(traded * capital, amount), F.lit(cap))
    return traded * (base_bps + impact_bps * F.pow(F.coalesce(part, F.lit(cap)), F.lit(power))) / 1e4


def price_ahead(df: DataFrame, c: str = "close") -> DataFrame:
    """df with the symbol's own next date and its price (column c) then; one exchange by symbol."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    return df.withColumns({"_next": F.lead("trade_date").over(w), "_price": F.lead(c).over(w)})


def evaluated(held: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, trade_date, exit_date, gross, turnover, initial for holdings (by, trade_date, exit_date, symbol, weight, entry_price, exit_price).

    Names without an exit price fall out. Turnover is half the weight moved after the former weights have drifted with
    prices; the first date is all bought. Dates are numbered over the holdings, a portfolio's rows for each date, so that a
    name's former and next holding tell by their numbers whether it was kept.
    """
    by = list(by)
    ok = held.filter("exit_price is not null and entry_price <> 0").withColumn("_i", F.dense_rank().over(Window.partitionBy(*by).orderBy("trade_date") if by else Window.orderBy("trade_date")))
    value = F.col("weight") * F.col("exit_price") / F.col("entry_price")
    ok = ok.withColumn("_drift", value / F.sum(value).over(Window.partitionBy(*by, "_i")))
    own = Window.partitionBy(*by, "symbol").orderBy("_i")
    before = F.when(F.lag("_i").over(own) == F.col("_i") - 1, F.lag("_drift").over(own))
    gone = F.coalesce(F.lead("_i").over(own) != F.col("_i") + 1, F.lit(True))
    ok = ok.withColumns({"_moved": F.abs(F.col("weight") - F.coalesce(before, F.lit(0.0))), "_sold": F.when(gone, F.col("_drift")).otherwise(0.0)})
    r = F.col("weight") * (F.col("exit_price") / F.col("entry_price") - 1)
    day = ok.groupBy(*by, "trade_date", "exit_date", "_i").agg((F.sum(r) / F.sum("weight")).alias("gross"), F.sum("_moved").alias("_moved"), F.sum("_sold").alias("_sold"))
    w = Window.partitionBy(*by).orderBy("_i") if by else Window.orderBy("_i")
    moved = F.col("_moved") + F.coalesce(F.lag("_sold").over(w), F.lit(0.0))
    first = F.col("_i") == 1
    return day.select(*by, "trade_date", "exit_date", "gross", F.when(first, moved).otherwise(moved / 2).alias("turnover"), first.alias("initial"))


def backtest(df: DataFrame, k: int, weighting: str = "equal", bps: float = 10.0, exit_policy: str = "strict", c: Constraints = Constraints(), side: int = 1, short_k: int = 0, exit_: int = 0, entry: int = 0, price_in: str = "close", price_out: str = "close") -> DataFrame:  # noqa: B008
    """trade_date, exit_date, gross, turnover, fee, net for a top-k portfolio rebalanced on every date of df.

    Names are bought at price_in of their date, which the constraints look at too, and valued at price_out of the exit date.

    side -1 sells the k worst short. With short_k both legs run and their returns, turnovers and fees add up; the short leg
    takes no name of the long one, and a date without either leg has no period. exit_ and entry are the hysteresis of
    the holdings. The table is read once, and exits are each symbol's own next row.
    """
    strict = exit_policy == "strict"
    df = df.withColumns({"_out": F.col(price_out), "close": F.col(price_in)})
    source = price_ahead(df, "_out") if strict else df

    def leg(sign: int, many: int) -> DataFrame:
        rows = source
        if sign < 0 and short_k:
            n = F.count(F.lit(1)).over(Window.partitionBy("trade_date"))
            rows = rows.withColumn("_room", n - k)
        rows = rows.withColumn("_score", sign * F.col("s"))
        held = buffered(rows, many, exit_, entry, "_score", c) if exit_ or entry else select(rows, many, "_score", c)
        if sign < 0 and short_k:
            held = held.filter("place <= _room")
        kept = ["_next", "_price"] if strict else []
        return weights(held, weighting, "_score").select(F.lit(sign).alias("side"), "trade_date", "symbol", "weight", F.col("close").alias("entry_price"), *kept)

    legs = leg(1, k).unionByName(leg(-1, short_k)) if short_k else leg(side, k)
    dated = legs.join(F.broadcast(periods(df)), "trade_date")  # a row for each date
    if strict:
        priced = dated.withColumn("exit_price", F.when(F.col("_next") == F.col("exit_date"), F.col("_price")))
    else:
        priced = exits(dated, df.select("symbol", "trade_date", F.col("_out").alias("close")), exit_policy)
    made = evaluated(priced, ["side"]).withColumn("fee", bps_fee(F.col("turnover"), F.col("initial"), bps)).withColumn("gross", F.col("gross") * F.col("side"))
    if short_k:
        both = made.groupBy("trade_date", "exit_date").agg(*(F.sum(x).alias(x) for x in ("gross", "turnover", "fee")), F.count(F.lit(1)).alias("_legs"))
        made = both.filter("_legs = 2")
    return made.withColumn("net", F.col("gross") - F.col("fee")).select("trade_date", "exit_date", "gross", "turnover", "fee", "net")


@dataclass(frozen=True)
class Variant:
    """One setting of a parameter grid."""

    k: int
    bps: float = 10.0
    weighting: str = "equal"
    exit_: int = 0
    entry: int = 0

    def name(self) -> str:
        return f"k{self.k}_{self.weighting}_bps{self.bps:g}_x{self.exit_}_e{self.entry}"


def trials(space: dict[str, Sequence[object]], most: int | None = None, seed: int = 1) -> list[Variant]:
    """The product of a search space, or `most` different settings of it drawn with a seed."""
    every = [Variant(**dict(zip(space, values, strict=True))) for values in product(*space.values())]
    return every if most is None or most >= len(every) else Random(seed).sample(every, most)


def grid(df: DataFrame, variants: Sequence[Variant]) -> DataFrame:
    """One row for each variant: periods, mean gross, turnover, fee and net, total net return.

    All variants share one ranking of the table; the grid is the broadcast side and meets only the first names of each date.
    """
    table = df.sparkSession.createDataFrame([(v.name(), v.k, float(v.bps), v.weighting, v.exit_, v.entry) for v in variants], "variant string, k int, bps double, weighting string, exit_ int, entry int")
    most = max(v.k + max(0, v.exit_) for v in variants)
    ranked = select(price_ahead(df), most).select("trade_date", "symbol", "s", "place", F.col("close").alias("entry_price"), "_next", "_price")
    met = ranked.join(F.broadcast(table), F.col("place") <= F.col("k") + F.col("exit_"))
    if any(v.exit_ or v.entry for v in variants):
        held = held_names(met, F.col("k"), F.col("exit_"), F.col("entry"), ("variant",))
        met = met.join(held, ["variant", "trade_date", "symbol"], "left_semi")  # a portfolio's rows for each date
    else:
        met = met.filter("place <= k")
    day = Window.partitionBy("variant", "trade_date")
    z = F.coalesce(safe_div(F.col("s") - F.avg("s").over(day), F.stddev_pop("s").over(day)), F.lit(0.0))
    met = met.withColumn("_e", F.exp(F.greatest(F.lit(-5.0), F.least(z, F.lit(5.0)))))
    held = met.withColumn("weight", F.when(F.col("weighting") == "equal", 1 / F.count(F.lit(1)).over(day)).otherwise(F.col("_e") / F.sum("_e").over(day)))
    held = held.join(F.broadcast(periods(df)), "trade_date").withColumn("exit_price", F.when(F.col("_next") == F.col("exit_date"), F.col("_price")))
    made = evaluated(held, ["variant"]).join(F.broadcast(table.select("variant", "bps")), "variant")
    fee = F.when(F.col("initial"), F.col("bps") / 1e4).otherwise(2 * F.col("turnover") * F.col("bps") / 1e4)
    made = made.withColumn("fee", fee).withColumn("net", F.col("gross") - F.col("fee"))
    return made.groupBy("variant").agg(F.count(F.lit(1)).alias("periods"), *(F.avg(x).alias(x) for x in ("gross", "turnover", "fee", "net")), (F.product(1 + F.col("net")) - 1).alias("total_return"))


def capacity(prices: DataFrame, liquidity: list[str], participation: float, capital: float, tradable: str | None = None) -> DataFrame:
    """prices with capacity: the weight that can be traded in a day; 0 where untradable or unknown."""
    least = F.least(*(F.col(c) for c in liquidity)) if len(liquidity) > 1 else F.col(liquidity[0])
    ok = F.col("close").isNotNull() & (F.coalesce(F.col(tradable), F.lit(False)) if tradable else F.lit(True))
    return prices.withColumn("capacity", F.when(ok, F.coalesce(participation * least / capital, F.lit(0.0))).otherwise(0.0))


def sell_fills(orders: DataFrame, days: DataFrame) -> DataFrame:
    """order_id, trade_date, filled, left: each order (order_id, symbol, requested, start, stop) meets its days' capacity in turn.

    A running sum of capacity clipped at the request is the whole simulation, as sells do not compete.
    """
    met = orders.join(days.select("symbol", "trade_date", "capacity"), "symbol").filter("trade_date between start and stop")
    w = Window.partitionBy("order_id").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    done = F.least(F.sum("capacity").over(w), F.col("requested"))
    prev = F.coalesce(F.lag(F.col("_done")).over(Window.partitionBy("order_id").orderBy("trade_date")), F.lit(0.0))
    return met.withColumn("_done", done).withColumn("filled", F.col("_done") - prev).select("order_id", "trade_date", "filled", (F.col("requested") - F.col("_done")).alias("left"))


def buy_fills(orders: DataFrame, days: DataFrame, cash: float, most_days: int = 5) -> DataFrame:
    """order_id, trade_date, filled: cash (a weight) couples a date's orders, so each rebalance is one fold over its days.

    Each day every open order asks for the least of what is left and its capacity; all are scaled alike to the cash left.
    One rebalance's orders are a portfolio, at most some hundreds of rows. An order is open for the first `most_days` dates with
    capacity from its start and is then given up.
    """
    met = orders.join(days.select("symbol", "trade_date", "capacity"), "symbol").filter("trade_date >= start")
    day = F.dense_rank().over(Window.partitionBy("rebalance_date").orderBy("trade_date"))
    met = met.withColumn("day", day).filter(F.col("day") <= most_days)
    per_day = met.groupBy("rebalance_date", "day", "trade_date").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("order_id", "capacity")))).alias("cap"))
    asked = orders.groupBy("rebalance_date").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("order_id", "requested")))).alias("left"))
    book = per_day.groupBy("rebalance_date").agg(F.array_sort(F.collect_list(F.struct("day", "trade_date", "cap")), lambda a, b: a["day"] - b["day"]).alias("days")).join(asked, "rebalance_date")
    start = F.struct(F.lit(cash).alias("cash"), F.col("left").alias("left"), F.array().cast("array<struct<trade_date:date,filled:map<bigint,double>>>").alias("fills"))

    def step(s: Column, d: Column) -> Column:
        want = F.transform_values(s["left"], lambda k, v: F.least(v, F.coalesce(F.try_element_at(d["cap"], k), F.lit(0.0))))
        total = F.aggregate(F.map_values(want), F.lit(0.0), lambda a, b: a + b)
        share = F.when(total > s["cash"], safe_div(s["cash"], total)).otherwise(F.lit(1.0))
        filled = F.transform_values(want, lambda k, v: v * F.coalesce(share, F.lit(0.0)))
        left = F.map_zip_with(s["left"], filled, lambda k, a, b: a - b)
        return F.struct(F.greatest(s["cash"] - total * F.coalesce(share, F.lit(0.0)), F.lit(0.0)).alias("cash"), left.alias("left"), F.array_append(s["fills"], F.struct(d["trade_date"].alias("trade_date"), filled.alias("filled"))).alias("fills"))

    out = book.select("rebalance_date", F.explode(F.aggregate("days", start, step)["fills"]).alias("f"))
    return out.select("rebalance_date", "f.trade_date", F.explode("f.filled").alias("order_id", "filled"))


def lots(targets: DataFrame, capital: float, buffer_bps: float = 0.0) -> DataFrame:
    """targets (symbol, weight, price, lot) with lots, value and gap: whole lots below each target value."""
    value = F.lit(capital * (1 - buffer_bps / 1e4)) * F.col("weight")
    n = F.coalesce(F.floor(safe_div(value, F.col("price") * F.col("lot"))), F.lit(0)).cast("long")
    return targets.withColumn("target_value", value).withColumn("lots", n).withColumn("value", F.col("lots") * F.col("lot") * F.col("price")).withColumn("gap", F.col("target_value") - F.col("value"))
