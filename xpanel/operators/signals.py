"""Quality of a score s against a target t, per date and in sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import average_rank, correlation, safe_div, t_two_sided
from . import crosssection as CS
from .portfolio import buffered


def daily_ic(df: DataFrame, s: str = "s", t: str = "t", method: str = "spearman", by: tuple[str, ...] = ("trade_date",)) -> DataFrame:
    """by, ic, n: correlation of complete pairs; dates whose target or score does not vary give none."""
    pairs = df.filter(F.col(s).isNotNull() & F.col(t).isNotNull())
    a, b = (average_rank(s, *by), average_rank(t, *by)) if method == "spearman" else (F.col(s), F.col(t))
    made = pairs.select(*by, a.alias("a"), b.alias("b")).groupBy(*by).agg(correlation("a", "b").alias("ic"), F.count(F.lit(1)).alias("n"))
    return made.filter("ic is not null")


def ic_summary(ic: DataFrame, *by: str) -> DataFrame:
    """n, mean, population deviation, their ratio, the t statistic and its two-sided probability with n - 1 degrees of freedom."""
    made = ic.groupBy(*by).agg(F.count("ic").alias("n"), F.avg("ic").alias("mean"), F.stddev_pop("ic").alias("std"))
    made = made.withColumn("ir", safe_div("mean", "std")).withColumn("t_stat", safe_div("mean", F.col("std") / F.sqrt("n")))
    return made.withColumn("p_value", t_two_sided("t_stat", F.col("n") - 1))


def quantile_returns(df: DataFrame, q: int = 5, s: str = "s", t: str = "t") -> DataFrame:
    """trade_date, bucket, mean target."""
    return df.withColumn("bucket", CS.bucket(s, q)).filter("bucket is not null").groupBy("trade_date", "bucket").agg(F.avg(t).alias("mean_target"))


def long_short(df: DataFrame, q: int = 5, s: str = "s", t: str = "t") -> DataFrame:
    """trade_date, spread: the last bucket's mean target less the first's."""
    b = quantile_returns(df, q, s, t)
    return b.groupBy("trade_date").agg((F.max_by("mean_target", "bucket") - F.min_by("mean_target", "bucket")).alias("spread"))


def errors(df: DataFrame, s: str = "s", t: str = "t") -> DataFrame:
    """mae, rmse, r2 and hit rate (equal signs, two zeros too) of complete pairs."""
    gap = F.col(t) - F.col(s)
    made = df.filter(F.col(s).isNotNull() & F.col(t).isNotNull())
    return made.agg(F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), (1 - F.try_divide(F.sum(gap * gap), F.var_pop(t) * F.count(t))).alias("r2"), F.avg((F.signum(s) == F.signum(t)).cast("double")).alias("hit_rate"))


def topk_positive(df: DataFrame, k: int, s: str = "s", t: str = "t") -> DataFrame:
    """Mean over dates of the share of the top k with a positive target."""
    top = CS.top_k(df.filter(F.col(t).isNotNull()), s, k)
    return top.groupBy("trade_date").agg(F.avg((F.col(t) > 0).cast("double")).alias("share")).agg(F.avg("share").alias("topk_positive"), F.count(F.lit(1)).alias("n_dates"))


def bucket_ic(df: DataFrame, bucket: str, least: int = 2) -> DataFrame:
    """IC summary for each value of a bucket column."""
    ic = daily_ic(df.filter(F.col(bucket).isNotNull()), by=("trade_date", bucket)).filter(F.col("n") >= least)
    return ic_summary(ic, bucket)


def turnover(df: DataFrame, k: int, s: str = "s", exit_: int = 0, entry: int = 0) -> DataFrame:
    """trade_date, turnover: share of the k names that were not held at the date before; sets, one row for each date.

    Dates of fewer than k names are left out. exit_ and entry are the hysteresis of the holdings.
    """
    top = CS.top_k(df, s, k)
    if exit_ or entry:
        whole = CS.top_k(df, s, k).select("trade_date").distinct()
        top = buffered(df.join(F.broadcast(whole), "trade_date", "left_semi"), k, exit_, entry, s)  # a row for each date
    held = top.groupBy("trade_date").agg(F.collect_set("symbol").alias("names"))
    before = F.lag("names").over(Window.orderBy("trade_date"))
    return held.withColumn("prev", before).filter("prev is not null").select("trade_date", (1 - F.size(F.array_intersect("names", "prev")) / k).alias("turnover"))


def factor_report(df: DataFrame, features: list[str], t: str = "t", q: int = 5) -> DataFrame:
    """One row for each feature: coverage, both IC means, shares of positive ICs, and the last bucket's mean target less the first's.

    All features are one long table: a date and feature is one group of one exchange, which ranks, buckets and sums share.
    """
    keys = ("trade_date", "feature")
    long = df.unpivot(["trade_date", "symbol", t], features, "feature", "s").withColumnRenamed(t, "t")
    long = long.withColumns({"_s": F.when(F.col("t").isNotNull(), F.col("s")), "_t": F.when(F.col("s").isNotNull(), F.col("t"))})
    group = Window.partitionBy(*keys)
    place = F.row_number().over(group.orderBy(F.col("s").asc_nulls_last(), "symbol"))
    long = long.withColumns({"_a": average_rank("_s", *keys), "_b": average_rank("_t", *keys), "_p": place, "_n": F.count("s").over(group)})
    bucket = F.when(F.col("s").isNotNull() & (F.col("_n") >= q), F.greatest(F.lit(0), F.ceil((F.col("_p") - 1) * q / (F.col("_n") - 1)) - 1))
    mean = lambda k: F.avg(F.when(bucket == k, F.col("t")))
    day = long.groupBy(*keys).agg(correlation("_a", "_b").alias("spearman"), correlation("_s", "_t").alias("pearson"), (mean(q - 1) - mean(0)).alias("spread"), F.count("s").alias("known"), F.count(F.lit(1)).alias("rows"))
    share = lambda m: F.avg((F.col(m) > 0).cast("double")).alias(f"positive_{m}")
    return day.groupBy("feature").agg((F.sum("known") / F.sum("rows")).alias("coverage"), *(x for m in ("spearman", "pearson") for x in (F.avg(m).alias(f"ic_{m}"), share(m))), F.avg("spread").alias("long_short"))


def rolling(series: DataFrame, c: str, n: int, ddof: int = 0, scale: Column | None = None) -> DataFrame:
    """trade_date, mean, std, ratio over the last n dates; null before n. A series has a row for each date."""
    w = Window.orderBy("trade_date").rowsBetween(-(n - 1), 0)
    full = F.count(c).over(w) >= n
    dev = F.stddev_pop(c).over(w) if ddof == 0 else F.stddev_samp(c).over(w)
    made = series.select("trade_date", F.when(full, F.avg(c).over(w)).alias("mean"), F.when(full, dev).alias("std"))
    return made.withColumn("ratio", safe_div("mean", "std") * (scale if scale is not None else F.lit(1.0)))
