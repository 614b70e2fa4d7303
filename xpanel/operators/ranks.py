"""Exact quantiles and positions over a whole table, without one task for all of its rows.

Approximate percentiles of a column (a mergeable sketch, OUTER * INNER values at the driver) split its range into bins of about equal
numbers of rows, however the values are spread; equal rows always share a bin, and the split points are constants of the plan, so every part of
it and every repeated task bins alike, if the values are the same each time they are computed: a sum or mean of doubles in the order of a shuffle is
not, and equal ones fall on both sides of a split point (`exprs.steady_mean` is). Counts of the bins, a row each, say which ranks a bin holds. Only bins that hold a wanted rank are
sorted, and values are counted before they are dealt, so a value that a third of the rows have is one row of a bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUTER, INNER = 32, 32


def bins(df: DataFrame, c: str, outer: int = OUTER, inner: int = INNER) -> Column:
    """The bin of c, ascending with its value, from 0; null for null. Runs one aggregation for the split points."""
    shares = [i / (outer * inner) for i in range(1, outer * inner)]
    found = df.select(F.percentile_approx(F.col(c).cast("double"), shares, outer * inner * 20)).first()[0] or []
    points = [*found, *[float("inf")] * (outer * inner - len(found))]
    edges = F.array(*(F.lit(points[i * inner + inner - 1]) for i in range(outer - 1)))
    parts = F.array(*(F.array(*(F.lit(p) for p in points[i * inner : i * inner + inner - 1])) for i in range(outer)))
    v = F.col(c).cast("double")
    below = lambda a: F.size(F.filter(a, lambda x: x <= v))
    at = below(edges)
    return F.when(v.isNotNull(), at * inner + below(F.get(parts, at)))


def _starts(counts: DataFrame) -> DataFrame:
    """_bin with before (rows of the bins below) and n (all rows); a row for each bin."""
    order = Window.orderBy("_bin")
    return counts.select("_bin", (F.sum("_many").over(order) - F.col("_many")).alias("before"), "_many", F.sum("_many").over(Window.partitionBy()).alias("n"))


def quantiles(df: DataFrame, c: str, shares: Sequence[float]) -> DataFrame:
    """share, value: the quantiles of c's values, interpolated between neighbours; nulls and NaN do not count. No values give no rows."""
    some = df.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))).select(F.col(c).cast("double").alias("_v"))
    values = some.groupBy("_v").agg(F.count(F.lit(1)).alias("_m")).withColumn("_bin", bins(some, "_v"))
    starts = _starts(values.groupBy("_bin").agg(F.sum("_m").alias("_many")))
    asked = df.sparkSession.createDataFrame([(float(p),) for p in shares], "share double")
    place = F.col("share") * (F.col("n") - 1)
    wanted = starts.crossJoin(F.broadcast(asked)).withColumn("_h", place).withColumn("_i", F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h")))))
    wanted = wanted.filter((F.col("_i") >= F.col("before")) & (F.col("_i") < F.col("before") + F.col("_many"))).select("_bin", "before", "share", "_h", "_i")  # two rows for each share
    within = Window.partitionBy("_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    held = values.join(F.broadcast(wanted.select("_bin").distinct()), "_bin", "left_semi").withColumn("_to", F.sum("_m").over(within))
    met = held.join(F.broadcast(wanted), "_bin").filter((F.col("_i") >= F.col("before") + F.col("_to") - F.col("_m")) & (F.col("_i") < F.col("before") + F.col("_to")))
    low, high = F.min("_v"), F.max("_v")
    return met.groupBy("share", "_h").agg((low + (F.col("_h") - F.floor("_h")) * (high - low)).alias("value")).select("share", "value")


def numbered(df: DataFrame, c: str, tie: str) -> DataFrame:
    """df with position (from 1, by c and then tie) and n, over all rows with a value; c must not depend on the order of rows.

    Rows with one value share a task, so c should not have a few values for most rows.
    """
    some = df.filter(F.col(c).isNotNull())
    binned = some.withColumn("_bin", bins(some, c))
    starts = _starts(binned.groupBy("_bin").agg(F.count(F.lit(1)).alias("_many"))).drop("_many")
    place = F.row_number().over(Window.partitionBy("_bin").orderBy(c, tie))
    return binned.withColumn("_p", place).join(F.broadcast(starts), "_bin").withColumn("position", F.col("before") + F.col("_p")).drop("_bin", "_p", "before")


def part_quantiles(positioned: DataFrame, part: str, c: str, shares: dict[str, float]) -> DataFrame:
    """part with n and the named quantiles of c within each part, where parts are runs of positions; only rows at wanted positions are gathered."""
    sizes = positioned.groupBy(part).agg(F.min("position").alias("_first"), F.count(F.lit(1)).alias("_many"))  # a row for each part
    both = positioned.select(part, c, "position").join(F.broadcast(sizes), part).withColumn("_i", F.col("position") - F.col("_first"))
    h = {name: F.lit(float(p)) * (F.col("_many") - 1) for name, p in shares.items()}
    near = lambda x: (F.col("_i") == F.floor(x)) | (F.col("_i") == F.ceil(x))
    any_ = F.lit(False)
    for x in h.values():
        any_ = any_ | near(x)
    low = lambda x: F.min(F.when(near(x), F.col(c)))
    high = lambda x: F.max(F.when(near(x), F.col(c)))
    made = both.filter(any_).groupBy(part, "_many").agg(*((low(x) + (x - F.floor(x)) * (high(x) - low(x))).alias(name) for name, x in h.items()))
    return made.withColumnRenamed("_many", "n")
