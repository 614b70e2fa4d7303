"""Windows across the symbols of each date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.exprs import ColumnOrName, average_rank, col, quantile_bucket, safe_div

def by_date() -> WindowSpec:
    return Window.partitionBy("trade_date")


def winsorize(c: ColumnOrName, p: float) -> Column:
    lo, hi = F.percentile(col(c), p).over(by_date()), F.percentile(col(c), 1 - p).over(by_date())
    return F.when(col(c).isNotNull(), F.greatest(F.least(col(c), hi), lo))


def zscore(c: ColumnOrName, fill: bool = True) -> Column:
    """Population z-score; with fill, nulls and dates without spread give 0."""
    z = safe_div(col(c) - F.avg(col(c)).over(by_date()), F.stddev_pop(col(c)).over(by_date()))
    return F.coalesce(z, F.lit(0.0)) if fill else z


def rank_pct(c: ColumnOrName) -> Column:
    """Average rank over count, less one half."""
    return average_rank(c, "trade_date") / F.count(col(c)).over(by_date()) - 0.5


def keep_nulls(c: ColumnOrName, made: Column) -> Column:
    return F.when(col(c).isNotNull(), made)


def median_fill(c: ColumnOrName) -> Column:
    return F.coalesce(col(c), F.percentile(col(c), 0.5).over(by_date()))


def missing_flag(c: ColumnOrName) -> Column:
    return col(c).isNull().cast("tinyint")


def neutralize_one(c: ColumnOrName, control: ColumnOrName, strength: float = 1.0, least: int = 3) -> Column:
    """c less strength times its per-date regression on one control with intercept."""
    both = col(c).isNotNull() & col(control).isNotNull()
    y, x = F.when(both, col(c)), F.when(both, col(control))
    slope = safe_div(F.covar_pop(y, x).over(by_date()), F.var_pop(x).over(by_date()))
    fit = F.avg(y).over(by_date()) + F.coalesce(slope, F.lit(0.0)) * (x - F.avg(x).over(by_date()))
    return F.when(both & (F.count(y).over(by_date()) >= least), y - strength * fit).otherwise(col(c))


def neutralize(df: DataFrame, c: str, controls: Sequence[str], strength: float = 1.0, least: int = 3, name: str = "neutral") -> DataFrame:
    """The same for several controls, by taking each control's own part out of c and of the controls after it.

    That is least squares with an intercept; all sums are windows over the date, so one exchange serves them. A control that the ones
    before it explain has no part of its own. Rows with a null stay as they are, as do dates of fewer rows than least.
    """
    names = [f"_x{i}" for i in range(len(controls))]
    whole = F.col(c).isNotNull()
    for x in controls:
        whole = whole & F.col(x).isNotNull()
    centred = lambda x: F.when(whole, F.col(x)) - F.avg(F.when(whole, F.col(x))).over(by_date())
    made = df.withColumns({"_y": centred(c), **{n: centred(x) for n, x in zip(names, controls, strict=True)}, "_n": F.count(F.when(whole, F.lit(1))).over(by_date())})
    made = made.withColumns({f"{n}s": F.sum(F.col(n) * F.col(n)).over(by_date()) for n in names})
    for i, n in enumerate(names):
        size = F.sum(F.col(n) * F.col(n)).over(by_date())
        own = F.when(size > 1e-10 * F.col(f"{n}s"), size)
        rest = {o: F.col(o) - F.coalesce(F.sum(F.col(o) * F.col(n)).over(by_date()) / own, F.lit(0.0)) * F.col(n) for o in ("_y", *names[i + 1 :])}
        made = made.withColumns(rest)
    fit = F.col(c) - F.avg(F.when(whole, F.col(c))).over(by_date()) - F.col("_y")
    out = F.when(whole & (F.col("_n") >= least), F.col(c) - strength * (fit + F.avg(F.when(whole, F.col(c))).over(by_date()))).otherwise(F.col(c))
    return made.withColumn(name, out).drop("_y", "_n", *names, *(f"{n}s" for n in names))


def composite(*cs: str) -> Column:
    """Mean of the z-scores."""
    total = F.lit(0.0)
    for c in cs:
        total = total + zscore(c)
    return total / len(cs)


def bucket(c: ColumnOrName, q: int, tie: str = "symbol") -> Column:
    """Quantile bucket 0..q-1 within the date, ties by symbol; null for nulls and for dates of fewer than q values."""
    missing = col(c).isNull()
    place = F.row_number().over(Window.partitionBy("trade_date", missing).orderBy(col(c), tie))
    return F.when(~missing, quantile_bucket(place, F.count(col(c)).over(by_date()), q))


def top_k(df: DataFrame, c: str, k: int, whole: bool = True) -> DataFrame:
    """The k largest of each date, ties by symbol; dates of fewer rows are left out if whole."""
    placed = df.filter(F.col(c).isNotNull()).withColumn("place", F.row_number().over(by_date().orderBy(F.desc(c), "symbol"))).withColumn("_n", F.count(F.lit(1)).over(by_date()))
    return placed.filter((F.col("place") <= k) & ((F.col("_n") >= k) if whole else F.lit(True))).drop("_n")


def permute(df: DataFrame, c: str, seed: int, name: str = "permuted") -> DataFrame:
    """c dealt anew within each date by a seeded hash of the symbols."""
    a = df.withColumn("_i", F.row_number().over(by_date().orderBy("symbol")))
    b = df.select("trade_date", F.col(c).alias(name), F.row_number().over(by_date().orderBy(F.xxhash64(F.lit(seed), "symbol"), "symbol")).alias("_i"))
    return a.join(b, ["trade_date", "_i"]).drop("_i")


def complete_case(df: DataFrame, *cs: str) -> DataFrame:
    return df.na.drop(subset=list(cs))


def least_symbols(df: DataFrame, n: int) -> DataFrame:
    """Dates with at least n different symbols; counted before the join, so only dates travel."""
    good = df.groupBy("trade_date").agg(F.countDistinct("symbol").alias("n")).filter(F.col("n") >= n)
    return df.join(good.select("trade_date"), "trade_date", "left_semi")
