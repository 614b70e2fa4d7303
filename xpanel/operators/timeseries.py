"""Windows along each symbol's own rows. One exchange by symbol serves all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.exprs import ColumnOrName, col, gated, safe_div


def along(by: Sequence[str] = ("symbol",), order: str = "trade_date") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def last_rows(n: int, w: WindowSpec | None = None) -> WindowSpec:
    return (w or along()).rowsBetween(-(n - 1), 0)


def sma(c: ColumnOrName, n: int, least: int | None = None) -> Column:
    w = last_rows(n)
    return gated(F.avg(col(c)).over(w), c, w, least or n)


def filled(c: ColumnOrName) -> Column:
    """The last value so far."""
    return F.last(col(c), ignorenulls=True).over(along().rowsBetween(Window.unboundedPreceding, 0))


def pct_change(c: ColumnOrName, n: int = 1) -> Column:
    """Change against n rows before; interior gaps are bridged by the last value."""
    v = filled(c)
    return F.try_divide(v, F.last(col(c), ignorenulls=True).over(along().rowsBetween(Window.unboundedPreceding, -n))) - 1 if n else v * 0


def with_return(df: DataFrame, c: str = "close", n: int = 1, name: str = "ret") -> DataFrame:
    return df.withColumn(name, F.try_divide(col(c), F.lag(c, n).over(along())) - 1)


def realized_vol(ret: ColumnOrName, n: int) -> Column:
    w = last_rows(n)
    return gated(F.stddev_pop(col(ret)).over(w), ret, w, n)


def lagged_mean(c: ColumnOrName, n: int) -> Column:
    """Mean of up to n earlier rows."""
    return F.avg(col(c)).over(along().rowsBetween(-n, -1))


def lagged_median(c: ColumnOrName, n: int) -> Column:
    return F.percentile(col(c), 0.5).over(along().rowsBetween(-n, -1))


def ffill(df: DataFrame, c: str, limit: int | None = None, name: str | None = None) -> DataFrame:
    """Forward fill, over at most `limit` rows after a value."""
    w = along()
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    value = F.last(c, ignorenulls=True).over(so_far)
    if limit is not None:
        df = df.withColumn("_row", F.row_number().over(w))
        age = F.col("_row") - F.last(F.when(F.col(c).isNotNull(), F.col("_row")), ignorenulls=True).over(so_far)
        value = F.when(age <= limit, value)
    return df.withColumn(name or c, value).drop("_row")


def delta(c: ColumnOrName) -> Column:
    return col(c) - F.lag(col(c)).over(along())


def growth(c: ColumnOrName) -> Column:
    """Change over the mean magnitude of both values."""
    before = F.lag(col(c)).over(along())
    return safe_div(col(c) - before, (F.abs(col(c)) + F.abs(before)) / 2)


def rolling_beta(ret: ColumnOrName, market: ColumnOrName, n: int = 120, least: int = 60) -> Column:
    w = last_rows(n)
    return gated(safe_div(F.covar_pop(col(ret), col(market)).over(w), F.var_pop(F.when(col(ret).isNotNull(), col(market))).over(w)), F.when(col(ret).isNotNull(), col(market)), w, least)


def value_percentile(c: ColumnOrName, n: int) -> Column:
    """Share of the last n values that are at most the current one; null before n rows."""
    w = last_rows(n)
    seen = F.collect_list(col(c)).over(w)
    return gated(F.size(F.filter(seen, lambda v: v <= col(c))) / F.size(seen), c, w, n)


def value_zscore(c: ColumnOrName, n: int) -> Column:
    """z-score of the log value in the last n rows, sample deviation."""
    w, x = last_rows(n), F.when(col(c) > 0, F.log(col(c)))
    return gated(safe_div(x - F.avg(x).over(w), F.stddev_samp(x).over(w)), c, w, n)


def rolling_quantile(c: ColumnOrName, n: int, q: float) -> Column:
    w = last_rows(n)
    return gated(F.percentile(col(c), q).over(w), c, w, n)


def cross_up(c: str, trigger: str) -> Column:
    """At or above the trigger of the row before, after being below its own."""
    w = along()
    return F.coalesce((F.col(c) >= F.lag(trigger).over(w)) & (F.lag(c).over(w) < F.lag(trigger, 2).over(w)), F.lit(False))


BLOCK = 64  # known rows of a block of the scan


def smoothed(df: DataFrame, means: dict[str, tuple[str, float]]) -> DataFrame:
    """df with exponential means along each symbol (name to column and weight), started at the first value; nulls carry a mean on.

    A step v = d v + a x is a pair (decay, value), and runs of steps compose, so the scan has two levels. Inside a block of
    BLOCK known rows a mean is a scaled running sum; a block ends in one value, and those of a symbol's blocks are folded in
    order, which gives the carry into each. Rows are sorted once by symbol and then dealt by symbol and block, so a long history is
    shared by many tasks and every row costs the same. The columns are null in the same rows.
    """
    c = next(iter(means.values()))[0]
    w = Window.partitionBy("symbol").orderBy("trade_date")
    known = F.count(c).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("_n", known).withColumns({"_block": F.floor((F.col("_n") - 1) / BLOCK).cast("int"), "_j": F.pmod(F.col("_n") - 1, F.lit(BLOCK)).cast("int")})
    inside = Window.partitionBy("symbol", "_block").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)

    def own(x: str, weight: float) -> Column:
        if weight == 1:
            return F.last(F.col(x), ignorenulls=True).over(inside)
        return weight * F.pow(F.lit(1 - weight), F.col("_j")) * F.sum(F.col(x) / F.pow(F.lit(1 - weight), F.col("_j"))).over(inside)

    rows = rows.withColumns({f"_own_{i}": own(x, weight) for i, (x, weight) in enumerate(means.values())})
    ends = rows.filter(F.col(c).isNotNull()).groupBy("symbol", "_block").agg(*(F.max_by(f"_own_{i}", "_n").alias(f"e{i}") for i in range(len(means))), *(F.min_by(x, "_n").alias(f"f{i}") for i, (x, _) in enumerate(means.values())))
    listed = ends.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("_block", *(f"{k}{i}" for i in range(len(means)) for k in "ef")))).alias("x"))

    def carries(i: int, weight: float) -> Column:
        """Into each block: the first value, then what the blocks before have left; all but the last are full."""
        decay = (1 - weight) ** BLOCK
        last = lambda a: F.get(a, F.size(a) - 1)
        return F.aggregate("x", F.array(F.get("x", F.lit(0))[f"f{i}"]), lambda a, b: F.array_append(a, decay * last(a) + b[f"e{i}"]))

    into = listed.select("symbol", *(carries(i, weight).alias(f"c{i}") for i, (_, weight) in enumerate(means.values()))).select("symbol", F.posexplode(F.arrays_zip(*(f"c{i}" for i in range(len(means))))).alias("_block", "_c"))
    both = rows.join(into, ["symbol", "_block"], "left")
    made = {name: F.when(F.col("_n") > 0, F.pow(F.lit(1 - weight), F.col("_j") + 1) * F.col("_c")[f"c{i}"] + F.col(f"_own_{i}")) for i, (name, (_, weight)) in enumerate(means.items())}
    return both.select(*df.columns, *(v.alias(n) for n, v in made.items()))


def ema(df: DataFrame, c: str, n: int, name: str) -> DataFrame:
    """df with name: exponential mean with weight 2 / (n + 1), started at the first value."""
    return smoothed(df, {name: (c, 2 / (n + 1))})


def macd_hist(df: DataFrame, c: str = "close", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """symbol, trade_date, macd_hist; every mean starts at its first value."""
    line = smoothed(df.select("symbol", "trade_date", c), {"_fast": (c, 2 / (fast + 1)), "_slow": (c, 2 / (slow + 1))})
    line = line.select("symbol", "trade_date", (F.col("_fast") - F.col("_slow")).alias("_line"))
    return smoothed(line, {"_signal": ("_line", 2 / (signal + 1))}).select("symbol", "trade_date", (F.col("_line") - F.col("_signal")).alias("macd_hist"))


def rsi(df: DataFrame, c: str = "close", n: int = 14) -> DataFrame:
    """symbol, trade_date, rsi: gains and losses smoothed with weight 1 / n from the first change on; null until n changes are known."""
    moved = df.select("symbol", "trade_date", delta(c).alias("_d")).filter("_d is not null")
    moved = moved.select("symbol", "trade_date", F.greatest("_d", F.lit(0.0)).alias("_up"), F.greatest(-F.col("_d"), F.lit(0.0)).alias("_down"))
    made = smoothed(moved, {"_u": ("_up", 1 / n), "_l": ("_down", 1 / n)}).withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy("trade_date")))
    total = F.col("_u") + F.col("_l")
    return made.select("symbol", "trade_date", F.when((F.col("_k") >= n) & (total > 0), 100 * F.col("_u") / total).alias("rsi"))


def calendar_stat(c: ColumnOrName, years: int, stat: str, least: int = 2) -> Column:
    """mean, std (sample), median or positive_ratio of the values of the last so many calendar years, the row's own included.

    The window goes by date: from the same day `years` before, exclusive. Null below `least` values.
    """
    day = F.col("trade_date")
    w = Window.partitionBy("symbol").orderBy(F.year(day) * 12 * 31 + F.month(day) * 31 + F.dayofmonth(day)).rangeBetween(-(years * 12 * 31) + 1, 0)
    x = col(c)
    made = {"mean": F.avg(x), "std": F.stddev_samp(x), "median": F.percentile(x, 0.5), "positive_ratio": F.avg((x > 0).cast("double"))}[stat]
    return F.when(F.count(x).over(w) >= least, made.over(w))


def calendar_cagr(df: DataFrame, c: str, years: int, name: str = "cagr") -> DataFrame:
    """df with the yearly growth of c since the latest row at least `years` calendar years back; null unless both are above 0."""
    from .joins import asof

    back = df.withColumn("_then", F.add_months("trade_date", -12 * years))
    old = df.filter(F.col(c).isNotNull()).select("symbol", F.col("trade_date").alias("_then"), F.col(c).alias("_old"))
    both = asof(back, old, ["symbol"], "_then", ["_old"])
    good = (F.col("_old") > 0) & (F.col(c) > 0)
    return both.withColumn(name, F.when(good, F.pow(F.col(c) / F.col("_old"), F.lit(1 / years)) - 1)).drop("_then", "_old")


def session_bars(ticks: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """by with open, high, low, close, n, volume, amount and vwap of ticks (price, size); vwap is null without volume."""
    at, worth = F.struct(*order), F.col("price") * F.col("size")
    made = ticks.groupBy(*by).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume"), F.sum(worth).alias("amount"))
    return made.withColumn("vwap", safe_div("amount", "volume"))


def bar_vwap(bars: DataFrame, by: Sequence[str]) -> DataFrame:
    """by with bars, volume and vwap: the means of open, high, low and close weighted by volume. Bars without a price or volume do not count; null without volume."""
    mean = (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4
    ok = mean.isNotNull() & (F.col("volume") > 0)
    made = bars.groupBy(*by).agg(F.count_if(ok).alias("bars"), F.sum(F.when(ok, F.col("volume"))).alias("volume"), F.sum(F.when(ok, mean * F.col("volume"))).alias("_w"))
    return made.select(*by, "bars", "volume", safe_div("_w", "volume").alias("vwap"))
