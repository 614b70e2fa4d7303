"""Weighted benchmarks, their attribution, and a portfolio's exposure against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import safe_div


def members(panel: DataFrame, caps: DataFrame, weighting: str = "cap") -> DataFrame:
    """trade_date, symbol, industry, weight, r, contribution for the step to the next date; caps must be above 0."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    rows = panel.select("trade_date", "symbol", (safe_div(F.lead("close").over(w), "close") - 1).alias("r")).filter("r is not null").join(caps, "symbol")
    raw = F.when(F.col("cap") > 0, F.col("cap")) if weighting == "cap" else F.lit(1.0)
    day = Window.partitionBy("trade_date")
    made = rows.withColumn("_w", raw).filter("_w is not null").withColumn("weight", F.col("_w") / F.sum("_w").over(day))
    return made.withColumn("contribution", F.col("weight") * F.col("r")).select("trade_date", "symbol", "industry", "weight", "r", "contribution")


def series(m: DataFrame) -> DataFrame:
    """trade_date, r, n and concentration: largest weight, sum of squares, effective number."""
    made = m.groupBy("trade_date").agg(F.sum("contribution").alias("r"), F.count(F.lit(1)).alias("n"), F.max("weight").alias("top1"), F.sum(F.col("weight") * F.col("weight")).alias("hhi"))
    return made.withColumn("effective_n", safe_div(F.lit(1.0), "hhi"))


def contributions(m: DataFrame, by: str) -> DataFrame:
    """By symbol or industry: periods, weights, summed contribution with its share, and counts of either sign."""
    made = m.groupBy(by).agg(F.countDistinct("trade_date").alias("periods"), F.avg("weight").alias("mean_weight"), F.percentile("weight", 0.5).alias("median_weight"), F.sum("contribution").alias("contribution"), F.count_if(F.col("contribution") > 0).alias("positive"), F.count_if(F.col("contribution") < 0).alias("negative"))
    total = made.agg(F.sum("contribution").alias("_t"))
    return made.join(F.broadcast(total)).withColumn("share", safe_div("contribution", "_t")).drop("_t")


def industry_exposure(held: DataFrame, m: DataFrame) -> DataFrame:
    """trade_date, industry, held weight, benchmark weight and the active difference; absent sides are 0."""
    a = held.groupBy("trade_date", F.coalesce("industry", F.lit("unknown")).alias("industry")).agg(F.sum("weight").alias("portfolio"))
    b = m.groupBy("trade_date", F.coalesce("industry", F.lit("unknown")).alias("industry")).agg(F.sum("weight").alias("benchmark"))
    both = a.join(b, ["trade_date", "industry"], "full_outer").fillna(0.0, ["portfolio", "benchmark"])
    return both.withColumn("active", F.col("portfolio") - F.col("benchmark"))


def style_exposure(held: DataFrame, universe: DataFrame, style: str) -> DataFrame:
    """trade_date, portfolio, equal, active: weighted means of a style's cross-sectional z-score."""
    day = Window.partitionBy("trade_date")
    z = safe_div(F.col(style) - F.avg(style).over(day), F.stddev_pop(style).over(day))
    scored = universe.withColumn("_z", F.when(F.count(style).over(day) >= 2, z)).select("trade_date", "symbol", "_z")
    equal = scored.groupBy("trade_date").agg(F.avg("_z").alias("equal"))
    mine = held.join(scored, ["trade_date", "symbol"]).filter("_z is not null").groupBy("trade_date").agg(safe_div(F.sum(F.col("weight") * F.col("_z")), F.sum("weight")).alias("portfolio"))
    return mine.join(equal, "trade_date").withColumn("active", F.col("portfolio") - F.col("equal"))


def period_series(spans: DataFrame, universe: DataFrame, prices: DataFrame, caps: DataFrame) -> DataFrame:
    """One row for each span (entry_date, exit_date): members, used, coverage_pct, r, top1, top5, hhi, effective_n.

    Members are those of the latest universe (rebalance_date, symbol) at or before the entry; a member counts with the exact prices of
    both dates and its latest cap (trade_date, symbol, cap) above 0. Spans are a calendar's size, members spans times universe.
    """
    from .joins import asof

    when = universe.select(F.lit(0).alias("k"), F.col("rebalance_date").alias("entry_date"), "rebalance_date").distinct()
    dated = asof(spans.select(F.lit(0).alias("k"), "entry_date", "exit_date"), when, ["k"], "entry_date", ["rebalance_date"]).filter("rebalance_date is not null").drop("k")
    rows = universe.select("rebalance_date", "symbol").distinct().join(F.broadcast(dated), "rebalance_date").select("entry_date", "exit_date", "symbol")  # a row for each span
    rows = asof(rows, caps.select("symbol", F.col("trade_date").alias("entry_date"), "cap").filter("cap is not null"), ["symbol"], "entry_date", ["cap"])
    at = lambda d: prices.select("symbol", F.col("trade_date").alias(d), F.col("close").alias(f"_{d}"))
    rows = rows.join(at("entry_date"), ["symbol", "entry_date"], "left").join(at("exit_date"), ["symbol", "exit_date"], "left")
    r = safe_div("_exit_date", "_entry_date") - 1
    rows = rows.withColumn("r", r).withColumn("_w", F.when(F.col("r").isNotNull() & (F.col("cap") > 0), F.col("cap")))
    span = Window.partitionBy("entry_date")
    rows = rows.withColumn("weight", F.col("_w") / F.sum("_w").over(span)).withColumn("_k", F.row_number().over(span.orderBy(F.col("weight").desc_nulls_last(), "symbol")))
    made = rows.groupBy("entry_date", "exit_date").agg(F.count(F.lit(1)).alias("members"), F.count("weight").alias("used"), F.sum(F.col("weight") * F.col("r")).alias("r"), F.max("weight").alias("top1"), F.sum(F.when(F.col("_k") <= 5, F.col("weight"))).alias("top5"), F.sum(F.col("weight") * F.col("weight")).alias("hhi"))
    return made.withColumns({"coverage_pct": 100.0 * F.col("used") / F.col("members"), "effective_n": safe_div(F.lit(1.0), "hhi")})
