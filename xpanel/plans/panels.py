"""Panels of (trade_date, symbol) rows made from the driver's tables, and the same as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _lines(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    day = F.trunc(F.col("l_shipdate").cast("date"), unit)
    grouped = read(spark, sf_dir, "lineitem").groupBy(day.alias("trade_date"), F.col("l_suppkey").cast("string").alias("symbol"))
    made = grouped.agg((F.floor(F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity")) * 10000 + 0.50001) / 10000).alias("close"), F.sum("l_quantity").alias("vol"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))
    return made.filter("trade_date is not null and symbol is not null")


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "MM")


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "week")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, cap, industry."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("s_acctbal").alias("cap"), "s_nationkey")
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.trim("n_name").alias("industry"))
    return s.join(n, "s_nationkey", "left").select("symbol", "cap", "industry")


def intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, trade_date, price, size, from events; rows without a value or user are left out."""
    e = read(spark, sf_dir, "events").filter("value is not null and user_id is not null and ts is not null")
    return e.select(F.col("user_id").cast("string").alias("symbol"), "ts", F.col("ts").cast("date").alias("trade_date"), F.col("value").cast("double").alias("price"), F.col("event_id"))


PM = """pm AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date, CAST(l_suppkey AS VARCHAR) AS symbol,
    floor(sum(l_extendedprice) / nullif(sum(l_quantity), 0) * 10000 + 0.50001) / 10000 AS close, sum(l_quantity) AS vol, round(sum(l_extendedprice), 2) AS amount
  FROM lineitem WHERE l_shipdate IS NOT NULL AND l_suppkey IS NOT NULL GROUP BY 1, 2)"""
PW = PM.replace("pm AS", "pw AS").replace("'month'", "'week'")
SUP = """sup AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, s_acctbal AS cap, trim(n_name) AS industry
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)"""
EV = """ev AS (SELECT CAST(user_id AS VARCHAR) AS symbol, ts, CAST(ts AS DATE) AS trade_date, CAST(value AS DOUBLE) AS price, event_id
  FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL)"""
IX = f"""{PW}, lv AS (SELECT trade_date, avg(close) AS close FROM pw GROUP BY 1),
lx AS (SELECT *, row_number() OVER (ORDER BY trade_date) - 1 AS idx, max(trade_date) OVER (PARTITION BY date_trunc('month', trade_date)) AS last FROM lv),
ix0 AS (SELECT trade_date, lag(idx) OVER (ORDER BY trade_date) AS entry_idx, idx + CASE WHEN idx % 5 = 0 THEN 1 ELSE 0 END AS exit_idx, idx AS planned_exit_idx, round(close / lag(close) OVER (ORDER BY trade_date) - 1, 8) AS r FROM lx WHERE trade_date = last),
ix AS (SELECT * FROM ix0 WHERE r IS NOT NULL)"""
W = "PARTITION BY symbol ORDER BY trade_date"
#: signal (three-month return) and one-month forward return, complete rows only
SC = f"""sg AS (SELECT *, close / nullif(lag(close, 3) OVER ({W}), 0) - 1 AS signal, lead(close) OVER ({W}) / nullif(close, 0) - 1 AS target FROM pm),
sc AS (SELECT *, round(signal, 8) AS s, round(target, 8) AS t FROM sg WHERE signal IS NOT NULL AND target IS NOT NULL)"""


def index_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_date, entry_idx, exit_idx, planned_exit_idx, r: the mean weekly price from month's end to month's end; gains, losses and recoveries.

    One row for each month; every fifth week's exit is a step late.
    """
    from pyspark.sql import Window

    level = weekly(spark, sf_dir).groupBy("trade_date").agg(F.avg("close").alias("close"))  # a row for each date
    days = Window.orderBy("trade_date")
    level = level.withColumns({"idx": F.row_number().over(days) - 1, "last": F.max("trade_date").over(Window.partitionBy(F.trunc("trade_date", "MM")))}).filter("trade_date = last")
    made = level.select("trade_date", F.lag("idx").over(days).alias("entry_idx"), (F.col("idx") + (F.col("idx") % 5 == 0).cast("int")).alias("exit_idx"), F.col("idx").alias("planned_exit_idx"), F.round(F.col("close") / F.lag("close").over(days) - 1, 8).alias("r"))
    return made.filter("r is not null")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly panel with a momentum signal s and its forward return t, complete rows only."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("trade_date")
    made = monthly(spark, sf_dir).withColumn("s", F.round(F.try_divide("close", F.lag("close", 3).over(w)) - 1, 8)).withColumn("t", F.round(F.try_divide(F.lead("close").over(w), F.col("close")) - 1, 8))
    return made.filter("s is not null and t is not null")
