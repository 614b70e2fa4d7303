"""Calendars. Tables here have a row for each date, whatever the panel's size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar(panel: DataFrame) -> DataFrame:
    """trade_date and its index from 0."""
    return panel.select("trade_date").distinct().withColumn("idx", F.row_number().over(Window.orderBy("trade_date")) - 1)


def rebalance_dates(panel: DataFrame, unit: str) -> DataFrame:
    """The last date of each day, week, month, quarter or year."""
    return panel.groupBy(F.trunc("trade_date", unit) if unit != "day" else F.col("trade_date")).agg(F.max("trade_date").alias("rebalance_date")).select("rebalance_date")


def rebalance_gap(panel: DataFrame, unit: str) -> DataFrame:
    """gap: the median number of dates between rebalances, halves rounded up."""
    at = calendar(panel).join(rebalance_dates(panel, unit).withColumnRenamed("rebalance_date", "trade_date"), "trade_date")
    gap = F.col("idx") - F.lag("idx").over(Window.orderBy("idx"))
    return at.select(gap.alias("g")).agg(F.floor(F.percentile("g", 0.5) + 0.5).alias("gap"))


def next_rebalance(panel: DataFrame, unit: str) -> DataFrame:
    """trade_date and the first rebalance date strictly behind it, null for none."""
    dates = panel.select("trade_date").distinct()
    marked = dates.join(rebalance_dates(panel, unit).select(F.col("rebalance_date").alias("trade_date"), F.col("rebalance_date")), "trade_date", "left")
    return marked.select("trade_date", F.first("rebalance_date", ignorenulls=True).over(Window.orderBy("trade_date").rowsBetween(1, Window.unboundedFollowing)).alias("next_rebalance"))


def shift(dates: DataFrame, cal: DataFrame, n: int, c: str = "trade_date") -> DataFrame:
    """dates with shifted: the date n open days later, null beyond the calendar."""
    a = cal.select(F.col("trade_date").alias(c), "idx")
    b = cal.select(F.col("trade_date").alias("shifted"), (F.col("idx") - n).alias("idx"))
    return dates.join(a, c).join(b, "idx", "left").drop("idx")


def label_windows(signals: DataFrame, cal: DataFrame, horizon: int, delay: int) -> DataFrame:
    """trade_date with start and stop of its label: `delay` dates later and `horizon` more."""
    made = shift(signals.select("trade_date").distinct(), cal, delay).withColumnRenamed("shifted", "start")
    return shift(made, cal, delay + horizon).withColumnRenamed("shifted", "stop")


def groups(dates: DataFrame, n: int) -> DataFrame:
    """trade_date and its contiguous group 0..n-1; the first groups are the longer ones."""
    return dates.select("trade_date").distinct().withColumn("grp", F.ntile(n).over(Window.orderBy("trade_date")) - 1)
