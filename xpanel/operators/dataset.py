"""From a canonical panel to modelling data: schema, labels, filters, transforms, sampling and holdouts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import number, safe_div
from . import crosssection as CS
from . import dates as D
from . import joins as J


@dataclass(frozen=True)
class PanelSpec:
    """Which columns of a table play which role; any table becomes a canonical panel."""

    date: str
    symbol: str
    price: str = "close"
    volume: str | None = "vol"
    amount: str | None = "amount"
    extras: tuple[str, ...] = ()

    def canonical(self, df: DataFrame) -> DataFrame:
        """Projected and normalised: dates as DATE, symbols stripped, rows with a null key dropped, numbers finite doubles or null."""
        wanted = [self.date, self.symbol, self.price, *(c for c in (self.volume, self.amount) if c), *self.extras]
        missing = [c for c in dict.fromkeys(wanted) if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        named = [F.col(self.date).cast("date").alias("trade_date"), F.trim(F.col(self.symbol).cast("string")).alias("symbol"), number(self.price).alias("close")]
        named += [number(c).alias(n) for c, n in ((self.volume, "vol"), (self.amount, "amount")) if c]
        return df.select(*named, *self.extras).filter("trade_date is not null and symbol is not null and symbol <> ''")


@dataclass(frozen=True)
class Recipe:
    """How modelling data are made."""

    features: tuple[str, ...]
    target: str = "t"
    target_winsorize: float | None = None
    transform: str = "none"  # of the features, within the date: none, zscore or rank
    train_target: str = "none"  # of the target, within the date: none, zscore or rank
    rebalance: str | None = None  # only the last date of each week, month, quarter
    least_symbols: int = 1


def _transformed(c: str, how: str):
    if how not in ("zscore", "rank"):
        raise ValueError(f"unknown transform {how!r}")
    return CS.keep_nulls(c, CS.zscore(c) if how == "zscore" else CS.rank_pct(c))


def pricing_frame(panel: DataFrame, columns: Sequence[str] = ("close",), order: Sequence[str] = ()) -> DataFrame:
    """trade_date, symbol and pricing columns, one row a key, taken before any filter: exits may be priced where the model saw nothing.

    Of a repeated key the row that is first by order stays, and among those alike in it the one of the smallest values, so that a repeated task
    keeps the same row.
    """
    first = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.struct(*columns).alias("row"))
    return panel.groupBy("trade_date", "symbol").agg(F.min(first).alias("_x")).select("trade_date", "symbol", *(F.col("_x.row").getField(c).alias(c) for c in columns))


def modeling_rows(panel: DataFrame, recipe: Recipe, universe: DataFrame | None = None) -> DataFrame:
    """Complete rows for training and evaluation, with train_target.

    In order: members of the latest universe, complete features, winsorised target, features' and then target's transform
    within the date, complete targets, rebalance dates, dates with enough symbols. The transforms share the one exchange by date.
    """
    rows = J.universe_asof(panel, universe) if universe is not None else panel
    rows = rows.na.drop(subset=["close", *recipe.features])
    if recipe.target_winsorize:
        rows = rows.withColumn(recipe.target, CS.winsorize(recipe.target, recipe.target_winsorize))
    if recipe.transform != "none":
        rows = rows.withColumns({f: _transformed(f, recipe.transform) for f in recipe.features})
    made = F.col(recipe.target) if recipe.train_target == "none" else _transformed(recipe.target, recipe.train_target)
    rows = rows.withColumn("train_target", made).na.drop(subset=[recipe.target, "train_target"])
    if recipe.rebalance:
        rows = rows.join(F.broadcast(D.rebalance_dates(rows, recipe.rebalance).withColumnRenamed("rebalance_date", "trade_date")), "trade_date", "left_semi")  # a row for each period
    return CS.least_symbols(rows, recipe.least_symbols) if recipe.least_symbols > 1 else rows


def dropped_dates(rows: DataFrame, least: int) -> DataFrame:
    """trade_date, n of the dates with fewer symbols than asked for."""
    return rows.groupBy("trade_date").agg(F.countDistinct("symbol").alias("n")).filter(F.col("n") < least)


def label_to_rebalance(panel: DataFrame, unit: str, delay: int = 0, horizon: int = 1, name: str = "t") -> DataFrame:
    """panel with the return from the price `delay` rows later to that of the next rebalance date, shifted alike.

    With fewer than two rebalance dates the label is that over `horizon` rows. A symbol without a row on that date has null.
    """
    w = Window.partitionBy("symbol").orderBy("trade_date")
    priced = panel.withColumns({"_entry": F.lead("close", delay).over(w) if delay else F.col("close"), "_later": F.lead("close", delay + horizon).over(w)})
    enough = D.rebalance_dates(panel, unit).agg((F.count(F.lit(1)) >= 2).alias("_enough"))  # one row
    dated = priced.join(F.broadcast(D.next_rebalance(panel, unit)), "trade_date", "left").crossJoin(F.broadcast(enough))
    exits = priced.select("symbol", F.col("trade_date").alias("next_rebalance"), F.col("_entry").alias("_exit"))
    both = dated.join(exits, ["symbol", "next_rebalance"], "left")
    return both.withColumn(name, safe_div(F.when(F.col("_enough"), F.col("_exit")).otherwise(F.col("_later")), "_entry") - 1).select(*panel.columns, name)


def holdout(panel: DataFrame, size: float) -> DataFrame:
    """panel with is_holdout: whether the date is among the last `size` (a count, or a share below 1) of its dates."""
    cal = D.calendar(panel)
    total = cal.agg(F.count(F.lit(1)).alias("_n"))  # one row
    many = F.lit(int(size)) if size >= 1 else F.floor(F.col("_n") * size)
    return panel.join(F.broadcast(cal.crossJoin(F.broadcast(total)).select("trade_date", (F.col("idx") >= F.col("_n") - many).alias("is_holdout"))), "trade_date")  # a row for each date


def train_window(panel: DataFrame, dates: int | None = None, years: float | None = None) -> DataFrame:
    """Rows of the last so many dates, or of the last so many years of 12 months; all without either."""
    cal = D.calendar(panel)
    ends = cal.agg(F.count(F.lit(1)).alias("_n"), F.max("trade_date").alias("_last"))  # one row
    keep = F.lit(True)
    if dates is not None:
        keep = F.col("idx") >= F.col("_n") - dates
    elif years is not None:
        keep = F.col("trade_date") > F.add_months("_last", -int(round(12 * years)))
    return panel.join(F.broadcast(cal.crossJoin(F.broadcast(ends)).filter(keep).select("trade_date")), "trade_date", "left_semi")


def without_benchmark(panel: DataFrame, symbols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The panel without the benchmark symbols, and their rows alone."""
    mine = F.col("symbol").isin(*symbols)
    return panel.filter(~mine), panel.filter(mine)


def holding_windows(positions: DataFrame) -> DataFrame:
    """positions with entry_date as yyyymmdd, next_entry_date and the text "a -> b" of the holding window (open at the last one)."""
    days = positions.select("entry_date").distinct().withColumn("_next", F.lead("entry_date").over(Window.orderBy("entry_date")))  # a row for each date
    text = lambda c: F.date_format(c, "yyyyMMdd")
    both = positions.join(F.broadcast(days), "entry_date")
    return both.withColumns({"entry_date": text("entry_date"), "next_entry_date": text("_next"), "holding_window": F.concat(text("entry_date"), F.lit(" -> "), F.coalesce(text("_next"), F.lit("")))}).drop("_next")


def availability(panel: DataFrame, features: Sequence[str], worst: int = 5) -> DataFrame:
    """feature, missing, dates, missing_pct, complete_rows, complete_dates, place of the `worst` features: most missing rows, fewest dates, then name descending."""
    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f).isNotNull()
    day = lambda c: F.countDistinct(F.when(c, F.col("trade_date")))
    aggs = [x for f in features for x in (F.count_if(F.col(f).isNull()).alias(f"{f}_m"), day(F.col(f).isNotNull()).alias(f"{f}_d"))]
    one = panel.agg(F.count(F.lit(1)).alias("_n"), F.count_if(whole).alias("complete_rows"), day(whole).alias("complete_dates"), *aggs)
    stack = ", ".join(f"'{f}', `{f}_m`, `{f}_d`" for f in features)
    long = one.selectExpr("_n", "complete_rows", "complete_dates", f"stack({len(features)}, {stack}) as (feature, missing, dates)")
    placed = long.withColumn("place", F.row_number().over(Window.orderBy(F.desc("missing"), "dates", F.desc("feature"))))  # a row for each feature
    return placed.filter(F.col("place") <= worst).withColumn("missing_pct", safe_div(100.0 * F.col("missing"), F.col("_n"))).drop("_n")


def coverage_by_date(panel: DataFrame, value: str, age: str) -> DataFrame:
    """trade_date, n, known_pct of the value, and mean, median, p90 and largest age of the known ones."""
    old = F.when(F.col(value).isNotNull(), F.col(age).cast("double"))
    return panel.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"), (100.0 * F.count(value) / F.count(F.lit(1))).alias("known_pct"), F.avg(old).alias("age_mean"), F.percentile(old, 0.5).alias("age_median"), F.percentile(old, 0.9).alias("age_p90"), F.max(old).alias("age_max"))


def tradable(panel: DataFrame, least_amount: float = 0.0, least_volume: float = 0.0, suspended: str | None = None, name: str = "is_tradable") -> DataFrame:
    """panel with name: a positive volume and amount of at least these sizes and no suspension; nulls are not tradable."""
    ok = (F.col("vol") > 0) & (F.col("amount") > 0) & (F.col("vol") >= least_volume) & (F.col("amount") >= least_amount)
    if suspended:
        ok = ok & ~F.coalesce(F.col(suspended), F.lit(False))
    return panel.withColumn(name, F.coalesce(ok, F.lit(False)))


def without_names(panel: DataFrame, instruments: DataFrame, pattern: str) -> DataFrame:
    """Rows of symbols whose name does not match the pattern (any case); symbols without a name stay. instruments: symbol, name."""
    bad = instruments.filter(F.lower("name").rlike(pattern.lower())).select("symbol").distinct()
    return panel.join(bad, "symbol", "left_anti")


def of_age(panel: DataFrame, days: int, instruments: DataFrame | None = None) -> DataFrame:
    """Rows at least so many days after the symbol's list_date, or after its first row where that is unknown."""
    first = F.min("trade_date").over(Window.partitionBy("symbol"))
    if instruments is None:
        return panel.withColumn("_listed", first).filter(F.col("trade_date") >= F.date_add("_listed", days)).drop("_listed")
    listed = instruments.select("symbol", F.col("list_date").alias("_listed"))
    both = panel.join(listed, "symbol", "left").withColumn("_listed", F.coalesce("_listed", first))
    return both.filter(F.col("trade_date") >= F.date_add("_listed", days)).select(*panel.columns)


def filled_after(panel: DataFrame, right: DataFrame, take: Sequence[str], limit: int | None = None) -> DataFrame:
    """panel with the take columns of the same date and symbol, then each carried on over at most `limit` rows of its symbol."""
    from .timeseries import ffill

    out = J.exact(panel, right, ["trade_date", "symbol"], take)
    for c in take:
        out = ffill(out, c, limit)
    return out


def period_plan(dates: DataFrame, cal: DataFrame, delay: int = 0, horizon: int | None = None) -> DataFrame:
    """rebalance_date, entry_date, exit_date, entry_idx, exit_idx: entry `delay` open days later, exit as late after the next rebalance, or `horizon` days after entry.

    Periods that the calendar (trade_date, idx) cannot hold fall out; with a horizon, so do those that begin before the last one's end.
    """
    made = dates.select("rebalance_date").distinct().join(cal.select(F.col("trade_date").alias("rebalance_date"), "idx"), "rebalance_date")
    order = Window.orderBy("idx")  # a row for each rebalance date
    made = made.select("rebalance_date", (F.col("idx") + delay).alias("entry_idx"), (F.col("idx") + delay + horizon if horizon else F.lead("idx").over(order) + delay).alias("exit_idx"))
    at = lambda n: cal.select(F.col("idx").alias(f"{n}_idx"), F.col("trade_date").alias(f"{n}_date"))
    both = made.join(at("entry"), "entry_idx").join(at("exit"), "exit_idx").select("rebalance_date", "entry_date", "exit_date", "entry_idx", "exit_idx")
    if not horizon:
        return both
    # greedy: a period counts if it begins at or after the end of the last one that counts; a fold over a row for each period
    rows = both.agg(F.array_sort(F.collect_list(F.struct("entry_idx", "exit_idx", "rebalance_date", "entry_date", "exit_date"))).alias("rows"))
    start = F.struct(F.lit(-1).cast("int").alias("end"), F.array().cast("array<int>").alias("kept"))
    step = lambda s_, x: F.when(x["entry_idx"] >= s_["end"], F.struct(x["exit_idx"].cast("int").alias("end"), F.array_append(s_["kept"], x["entry_idx"].cast("int")).alias("kept"))).otherwise(s_)
    kept = rows.select("rows", F.aggregate("rows", start, step)["kept"].alias("kept"))
    return kept.select(F.explode(F.filter("rows", lambda x: F.array_contains("kept", x["entry_idx"].cast("int")))).alias("x")).select("x.rebalance_date", "x.entry_date", "x.exit_date", "x.entry_idx", "x.exit_idx")
