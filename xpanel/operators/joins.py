"""Point-in-time joins. None forms pairs: an as-of join is a union, one exchange by key and a running last value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, take: Sequence[str], age: str | None = None) -> DataFrame:
    """left with the take columns of right's latest row at or before `on`; ties of date count as known."""
    some = right.filter(F.col(on).isNotNull())
    packed = F.struct(F.col(on).alias("_at"), *take)
    r = some.select(*by, on, F.lit(0).alias("_side"), packed.alias("_r"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_l"))
    l = left.select(*by, on, F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct("*").alias("_l"))  # noqa: E741
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(l).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    out = both.select("_l.*", *(F.col(f"_r.{c}").alias(c) for c in take), F.col("_r._at").alias("_at"))
    return out.withColumn(age, F.datediff(on, "_at")).drop("_at") if age else out.drop("_at")


def exact(left: DataFrame, right: DataFrame, by: Sequence[str], take: Sequence[str]) -> DataFrame:
    """Left join that refuses to overwrite columns."""
    clash = [c for c in take if c in left.columns]
    if clash:
        raise ValueError(f"columns in both: {', '.join(clash)}")
    return left.join(right.select(*by, *take), list(by), "left")


def overlay(left: DataFrame, right: DataFrame, by: Sequence[str], take: Sequence[str]) -> DataFrame:
    """Left join whose columns replace any of the same name."""
    return exact(left.drop(*take), right, by, take)


def universe_asof(panel: DataFrame, universe: DataFrame) -> DataFrame:
    """Rows of the members (rebalance_date, symbol) of the latest rebalance at or before each date; earlier dates go.

    Only different dates are matched by range (a table of the calendar's size); members join by equality.
    """
    dates = panel.select("trade_date").distinct().select(F.lit(0).alias("k"), "trade_date")
    when = universe.select(F.lit(0).alias("k"), F.col("rebalance_date").alias("trade_date"), "rebalance_date").distinct()
    mapped = asof(dates, when, ["k"], "trade_date", ["rebalance_date"]).filter("rebalance_date is not null").drop("k")
    return panel.join(F.broadcast(mapped), "trade_date").join(universe.select("rebalance_date", "symbol").distinct(), ["rebalance_date", "symbol"], "left_semi")


def keep_last(df: DataFrame, by: Sequence[str], order: Sequence[str], first: bool = False) -> DataFrame:
    """One row for each key: the last (or first) by the order columns."""
    keys = [F.asc(c) if first else F.desc(c) for c in order]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).filter("_n = 1").drop("_n")


def diff(new: DataFrame, old: DataFrame, by: Sequence[str], value: str, tolerance: float = 1e-12) -> DataFrame:
    """by, old_value, new_value, status (added, removed, changed); what did not change is left out."""
    a = new.select(*by, F.col(value).alias("new_value"))
    b = old.select(*by, F.col(value).alias("old_value"))
    both = a.join(b, list(by), "full_outer")
    status = F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").when(F.abs(F.col("new_value") - F.col("old_value")) >= tolerance, "changed")
    return both.withColumn("status", status).filter("status is not null")


def overlapping(events: DataFrame, tests: DataFrame, embargo_days: int = 0) -> DataFrame:
    """events (start, stop) that meet any test interval or begin in the embargo behind it.

    Test intervals are merged to disjoint ones first; then each event needs only the last interval that begins at or
    before its own stop, an as-of join instead of a range join.
    """
    t = tests.select("start", F.date_add("stop", embargo_days).alias("stop")).distinct()
    w = Window.orderBy("start")  # a calendar-sized table
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    merged = t.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("id", F.sum("new").over(w)).groupBy("id").agg(F.min("start").alias("t_start"), F.max("stop").alias("t_stop"))
    right = merged.select(F.lit(0).alias("k"), F.col("t_start").alias("stop"), "t_stop")
    stops = events.select(F.lit(0).alias("k"), "stop").distinct()  # different dates, so the one group is a calendar
    reached = asof(stops, right, ["k"], "stop", ["t_stop"]).filter("t_stop is not null").select("stop", "t_stop")
    return events.join(F.broadcast(reached), "stop").filter(F.col("t_stop") >= F.col("start")).select(*events.columns)


def value_at(df: DataFrame, by: str, value: str, date: str, exact: bool = False) -> DataFrame:
    """by, value: the one on the date, or the last that is not null at or before it (null if all are)."""
    day = F.lit(date).cast("date")
    if exact:
        return df.filter(F.col("trade_date") == day).select(by, F.col(value).alias("value"))
    known = df.filter(F.col("trade_date") <= day)
    return known.groupBy(by).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("trade_date"))).alias("value"))


def newcomers(members: DataFrame, date: str, by: str) -> DataFrame:
    """by of the members at the last date that were none at the date before."""
    last = members.select(date).distinct().withColumn("_n", F.row_number().over(Window.orderBy(F.desc(date)))).filter("_n <= 2")  # a row for each date
    two = members.join(F.broadcast(last), date)
    return two.filter("_n = 1").select(by).distinct().join(two.filter("_n = 2").select(by), by, "left_anti")


def labels_asof(df: DataFrame, history: DataFrame, label: str, missing: str | None = None) -> DataFrame:
    """df with its missing labels filled from the symbol's latest known one at or before the date (history: trade_date, symbol, label)."""
    known = history.filter(F.col(label).isNotNull()).select("symbol", "trade_date", F.col(label).alias("_known"))
    made = asof(df, known, ["symbol"], "trade_date", ["_known"])
    return made.withColumn(label, F.coalesce(label, "_known", *([F.lit(missing)] if missing else []))).drop("_known")


def by_label(universe: DataFrame, labels: DataFrame, label: str, chosen: Sequence[str], mode: str = "exclude", missing: str = "keep") -> DataFrame:
    """Rows of the universe whose symbol's label is (only) or is not (exclude) among the chosen ones; missing: keep or drop those without one.

    labels has one row for each symbol.
    """
    if mode not in ("exclude", "only") or missing not in ("keep", "drop"):
        raise ValueError(f"unknown mode {mode!r} or missing policy {missing!r}")
    both = universe.join(labels.select("symbol", F.col(label).alias("_label")), "symbol", "left")
    hit = F.col("_label").isin(*chosen)
    keep = F.when(F.col("_label").isNull(), F.lit(missing == "keep")).otherwise(hit if mode == "only" else ~hit)
    return both.filter(keep).select(*universe.columns)


def mapped(df: DataFrame, mapping: DataFrame, by: Sequence[str], source: str, target: str) -> DataFrame:
    """df with target: the mapping's value for its keys, or the source as it is where there is no rule. mapping has one row for each key."""
    both = df.join(mapping.select(*by, F.col(target).alias("_mapped")), list(by), "left")
    return both.withColumn(target, F.coalesce("_mapped", source)).drop("_mapped")


def with_label_of(df: DataFrame, labels: DataFrame, c: str, some: DataFrame) -> DataFrame:
    """The rows of df whose symbol has a label that some of the labelled rows have; labels: symbol, c. Two semi joins, nothing comes to the driver."""
    wanted = some.select(c).filter(F.col(c).isNotNull()).distinct()
    return df.join(labels.join(wanted, c, "left_semi").select("symbol").distinct(), "symbol", "left_semi")
