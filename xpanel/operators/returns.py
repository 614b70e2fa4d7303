"""Statistics of return series. A series (trade_date, r) has a row for each period, so its windows are calendar-sized."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from ..functions.exprs import correlation, safe_div, sample_kurtosis, sample_skew



def so_far() -> WindowSpec:
    return Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)


def compounded(r: str) -> Column:
    """Aggregate: the product of 1 + r, less 1."""
    return F.product(1 + F.col(r)) - 1


def nav(series: DataFrame, r: str = "r") -> DataFrame:
    """series with nav, its running maximum (at least 1) and drawdown."""
    made = series.filter(F.col(r).isNotNull()).withColumn("nav", F.product(1 + F.col(r)).over(so_far()))
    made = made.withColumn("peak", F.greatest(F.max("nav").over(so_far()), F.lit(1.0)))
    return made.withColumn("drawdown", F.col("nav") / F.col("peak") - 1)


def path(series: DataFrame, r: str = "r") -> DataFrame:
    """series in order with its position, nav, the running maximum of nav and the drawdown from it. One row a period."""
    made = series.filter(F.col(r).isNotNull()).withColumns({"position": F.row_number().over(Window.orderBy("trade_date")), "nav": F.product(1 + F.col(r)).over(so_far())})
    made = made.withColumn("peak", F.max("nav").over(so_far()))
    return made.withColumn("drawdown", F.when(F.col("nav") >= F.col("peak"), 0.0).otherwise(F.col("nav") / F.col("peak") - 1))


TIMING = ("drawdown_duration", "recovery_time", "drawdown_duration_days", "recovery_time_days")


def _timed(rows: DataFrame, trough: DataFrame) -> DataFrame:
    """One row: dates and lengths of the deepest drawdown; trough holds its first lowest row."""
    both = rows.crossJoin(F.broadcast(trough))  # one row
    top = F.when((F.col("nav") == F.col("_peak")) & (F.col("position") <= F.col("_at")), F.struct("position", "trade_date"))
    back = F.when((F.col("nav") >= F.col("_peak")) & (F.col("position") >= F.col("_at")), F.struct("position", "trade_date"))
    made = both.groupBy("_at", "trough_date", "depth").agg(F.max(top).alias("_top"), F.min(back).alias("_back"))
    return made.select(
        F.col("_top.trade_date").alias("peak_date"), "trough_date", F.col("_back.trade_date").alias("recovery_date"), "depth",
        (F.col("_at") - F.col("_top.position")).cast("double").alias("drawdown_duration"), (F.col("_back.position") - F.col("_at")).cast("double").alias("recovery_time"),
        F.datediff("trough_date", "_top.trade_date").cast("double").alias("drawdown_duration_days"), F.datediff("_back.trade_date", "trough_date").cast("double").alias("recovery_time_days"),
    )


def _trough(rows: DataFrame) -> DataFrame:
    low = F.min_by(F.struct("position", "trade_date", "peak", "drawdown"), F.struct("drawdown", "position"))
    return rows.agg(low.alias("x")).filter("x is not null").select(F.col("x.position").alias("_at"), F.col("x.trade_date").alias("trough_date"), F.col("x.peak").alias("_peak"), F.col("x.drawdown").alias("depth"))


def drawdown_timing(series: DataFrame, r: str = "r") -> DataFrame:
    """One row: depth, dates and lengths (periods, days) from the last peak to the deepest trough and back; no recovery is null."""
    rows = path(series, r)
    return _timed(rows, _trough(rows))


def summary(series: DataFrame, days_a_year: float, r: str = "r") -> DataFrame:
    """One row of 22 figures of a series (trade_date, r, entry_idx, exit_idx, planned_exit_idx), a row for each period.

    Years are counted in trading days: the whole return over those from the first entry to the last exit, deviations over the
    mean holding. Null figures are those that the series is too short or too even for.
    """
    rows = path(series, r)
    v = F.col(r)
    worst = F.percentile(r, 0.05).over(Window.partitionBy())  # a row for each period
    hold, lag = F.col("exit_idx") - F.col("entry_idx"), F.greatest(F.col("exit_idx") - F.col("planned_exit_idx"), F.lit(0))
    made = rows.withColumn("_v", worst).agg(
        F.count(r).alias("periods"), compounded(r).alias("total_return"), F.avg(r).alias("_mean"), F.stddev_samp(r).alias("_std"), F.min("drawdown").alias("max_drawdown"),
        F.avg(hold).alias("avg_holding"), (F.max_by("exit_idx", "trade_date") - F.min_by("entry_idx", "trade_date")).alias("_days"), F.sqrt(F.avg(F.least(v, F.lit(0.0)) * F.least(v, F.lit(0.0)))).alias("_down"),
        sample_skew(r).alias("skew"), sample_kurtosis(r).alias("kurtosis"), F.max("_v").alias("var_95"), F.avg(F.when(v <= F.col("_v"), v)).alias("cvar_95"),
        F.avg(lag).alias("avg_exit_lag_days"), F.max(lag).cast("double").alias("max_exit_lag_days"), F.count_if(lag > 0).alias("periods_with_delayed_exit"), F.avg((lag > 0).cast("double")).alias("delayed_exit_ratio"),
        F.min_by(F.struct("position", "trade_date", "peak", "drawdown"), F.struct("drawdown", "position")).alias("_low"),
        F.sort_array(F.collect_list(F.struct("position", "trade_date", "nav"))).alias("_path"),
    )
    a_year = safe_div(F.lit(days_a_year), F.when(F.col("avg_holding") > 0, F.col("avg_holding")))
    ratio = lambda d: F.when(F.col(d) > 0, F.col("_mean") / F.col(d) * F.sqrt("periods_per_year"))
    made = made.withColumn("periods_per_year", a_year).withColumns({
        "ann_return": F.when(F.col("_days") > 0, F.pow(1 + F.col("total_return"), days_a_year / F.col("_days")) - 1),
        "ann_vol": F.when(F.col("_std") > 0, F.col("_std") * F.sqrt("periods_per_year")), "sharpe": ratio("_std"), "sortino": ratio("_down"),
        "_top": F.try_element_at(F.filter("_path", lambda x: (x["position"] <= F.col("_low.position")) & (x["nav"] == F.col("_low.peak"))), F.lit(-1)),
        "_back": F.try_element_at(F.filter("_path", lambda x: (x["position"] >= F.col("_low.position")) & (x["nav"] >= F.col("_low.peak"))), F.lit(1)),
    })
    made = made.withColumns({
        "calmar": F.when(F.col("max_drawdown") < 0, F.col("ann_return") / F.abs("max_drawdown")),
        "drawdown_duration": (F.col("_low.position") - F.col("_top.position")).cast("double"), "recovery_time": (F.col("_back.position") - F.col("_low.position")).cast("double"),
        "drawdown_duration_days": F.datediff("_low.trade_date", "_top.trade_date").cast("double"), "recovery_time_days": F.datediff("_back.trade_date", "_low.trade_date").cast("double"),
    })
    return made.select(*SUMMARY)


SUMMARY = ("periods", "total_return", "ann_return", "ann_vol", "sharpe", "max_drawdown", "avg_holding", "periods_per_year", "sortino", "calmar", *TIMING, "skew", "kurtosis", "var_95", "cvar_95", "avg_exit_lag_days", "max_exit_lag_days", "periods_with_delayed_exit", "delayed_exit_ratio")


def episodes(series: DataFrame, r: str = "r", most: int = 10) -> DataFrame:
    """The deepest stretches below the running maximum: start, trough, last date below, depth, periods."""
    n = nav(series, r).withColumn("id", F.sum((F.col("drawdown") >= 0).cast("int")).over(so_far())).filter("drawdown < 0")
    made = n.groupBy("id").agg(F.min("trade_date").alias("start"), F.min_by("trade_date", F.struct("drawdown", "trade_date")).alias("trough"), F.max("trade_date").alias("last"), F.min("drawdown").alias("depth"), F.count(F.lit(1)).alias("periods"))
    return made.drop("id").orderBy("depth", "start").limit(most)


def resampled(series: DataFrame, unit: str, r: str = "r") -> DataFrame:
    """trade_date (start of the unit) and its compounded return."""
    return series.groupBy(F.trunc("trade_date", unit).alias("trade_date")).agg(compounded(r).alias("r"))


def _active(both: GroupedData, a_year: float, more: Sequence[Column] = ()) -> DataFrame:
    """Of columns a and b, both null or neither."""
    gap = F.col("a") - F.col("b")
    made = both.agg(F.count("a").alias("periods"), *more, F.avg(gap).alias("_m"), F.stddev_samp(gap).alias("_s"), safe_div(F.covar_samp("a", "b"), F.var_samp("b")).alias("beta"), F.avg("a").alias("_a"), F.avg("b").alias("_b"), correlation("a", "b").alias("corr"), (F.product(1 + F.col("a")) / F.product(1 + F.col("b")) - 1).alias("relative_return"))
    made = made.withColumn("tracking_error", F.col("_s") * a_year**0.5).withColumn("information_ratio", safe_div(F.col("_m") * a_year**0.5, "_s"))
    return made.withColumn("alpha", (F.col("_a") - F.col("beta") * F.col("_b")) * a_year).drop("_m", "_s", "_a", "_b")


def active(series: DataFrame, benchmark: DataFrame, a_year: float) -> DataFrame:
    """One row over dates in both: tracking error, information ratio, beta, alpha, correlation, relative return."""
    both = series.select("trade_date", F.col("r").alias("a")).join(benchmark.select("trade_date", F.col("r").alias("b")), "trade_date").filter("a is not null and b is not null")
    return _active(both.groupBy(), a_year)


def rolling_cagr(series: DataFrame, n: int, a_year: float, r: str = "r") -> DataFrame:
    w = Window.orderBy("trade_date").rowsBetween(-(n - 1), 0)
    return series.select("trade_date", F.when(F.count(r).over(w) >= n, F.pow(F.product(1 + F.col(r)).over(w), F.lit(a_year / n)) - 1).alias("cagr"))


def rolling_drawdown(series: DataFrame, n: int, r: str = "r") -> DataFrame:
    """The deepest drawdown within the last n periods; null before n.

    A stretch of periods is summed up by its growth, highest and lowest value and deepest fall, and two stretches in a row by theirs. Stretches
    of 1, 2, 4, ... periods come from two of the size before, one of them so many rows back; the window is put together from
    those that n is the sum of. So a row costs the logarithm of n, whatever the window.
    """
    order = Window.orderBy("trade_date")  # a row for each date
    v = 1 + F.col(r)
    state = lambda growth, high, low, fall: F.struct(growth.alias("growth"), high.alias("high"), low.alias("low"), fall.alias("fall"))

    def joined(a: Column, b: Column) -> Column:
        high, low = F.greatest(a["high"], a["growth"] * b["high"]), F.least(a["low"], a["growth"] * b["low"])
        return F.when(a.isNotNull() & b.isNotNull(), state(a["growth"] * b["growth"], high, low, F.least(a["fall"], b["fall"], a["growth"] * b["low"] / a["high"] - 1)))

    # values are relative to the one before the stretch, which counts as its first high and low
    one = F.when(F.col(r).isNotNull(), state(v, F.greatest(v, F.lit(1.0)), F.least(v, F.lit(1.0)), F.least(v - 1, F.lit(0.0))))
    made, whole, done, size = series.select("trade_date", F.col(r)).withColumn("_s", one), None, 0, 1
    while size <= n:
        if n & size:  # this stretch lies before what is there already
            before = F.lag("_s", done).over(order) if done else F.col("_s")
            made = made.withColumn("_w", joined(before, F.col("_w")) if whole else before)
            whole, done = True, done + size
        size *= 2
        if size <= n:
            made = made.withColumn("_s", joined(F.lag("_s", size // 2).over(order), F.col("_s")))
    return made.select("trade_date", F.col("_w.fall").alias("max_drawdown"))


def ladder(series: DataFrame, benchmarks: DataFrame, a_year: float, names: Sequence[str]) -> DataFrame:
    """Active statistics against each benchmark of a long table (benchmark, trade_date, r): one row for each name.

    status: ok, incompatible (fewer than two common dates) or missing (no row at all). One join serves all benchmarks.
    """
    both = benchmarks.select("benchmark", "trade_date", F.col("r").alias("b")).join(series.select("trade_date", F.col("r").alias("a")), "trade_date", "left")
    met = F.col("a").isNotNull() & F.col("b").isNotNull()
    both = both.select("benchmark", F.when(met, F.col("a")).alias("a"), F.when(met, F.col("b")).alias("b"))
    listed = series.sparkSession.createDataFrame([(n,) for n in names], "benchmark string")
    made = listed.join(_active(both.groupBy("benchmark"), a_year, [F.count(F.lit(1)).alias("rows")]), "benchmark", "left")
    status = F.when(F.col("rows").isNull(), "missing").when(F.coalesce("periods", F.lit(0)) < 2, "incompatible").otherwise("ok")
    return made.withColumn("status", status).withColumn("periods", F.coalesce("periods", F.lit(0))).drop("rows")


def benchmark_series(spans: DataFrame, returns: DataFrame | None = None, prices: DataFrame | None = None) -> DataFrame:
    """spans (entry_date, exit_date) with r: a return series' value on the exit date, or the exit price over the entry price.

    Periods without data fall out. returns has trade_date and r; prices trade_date and close, one row a date.
    """
    if returns is not None:
        return spans.join(returns.select(F.col("trade_date").alias("exit_date"), "r"), "exit_date").filter("r is not null").select("entry_date", "exit_date", "r")
    at = lambda d: prices.select(F.col("trade_date").alias(d), F.col("close").alias(f"_{d}"))
    both = spans.join(at("entry_date"), "entry_date").join(at("exit_date"), "exit_date")
    return both.withColumn("r", safe_div("_exit_date", "_entry_date") - 1).filter("r is not null").select("entry_date", "exit_date", "r")


def report(series: DataFrame, benchmark: DataFrame, n: int, a_year: float) -> DataFrame:
    """trade_date, r, nav, drawdown, benchmark_nav, active, relative_nav, rolling_sharpe; a date without benchmark has nulls."""
    both = series.select("trade_date", "r").join(benchmark.select("trade_date", F.col("r").alias("b")), "trade_date", "left")
    made = nav(both)
    w = Window.orderBy("trade_date").rowsBetween(-(n - 1), 0)
    made = made.withColumn("benchmark_nav", F.when(F.col("b").isNotNull(), F.product(1 + F.coalesce("b", F.lit(0.0))).over(so_far())))
    sharpe = F.when(F.count("r").over(w) >= n, safe_div(F.avg("r").over(w), F.stddev_samp("r").over(w)) * a_year**0.5)
    return made.select("trade_date", "r", "nav", "drawdown", "benchmark_nav", (F.col("r") - F.col("b")).alias("active"), safe_div("nav", "benchmark_nav").alias("relative_nav"), sharpe.alias("rolling_sharpe"))


def last_periods(runs: DataFrame, windows: Sequence[int], a_year: float) -> DataFrame:
    """run, window and the statistics of each run's last so many periods: periods, mean, sharpe, information ratio, turnover.

    runs: run, trade_date, r, b (benchmark), turnover. All windows are read off one numbering of each run's dates.
    """
    back = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("trade_date")))
    table = runs.sparkSession.createDataFrame([(int(w),) for w in windows], "window int")
    met = runs.withColumn("_n", back).filter(F.col("_n") <= max(windows)).join(F.broadcast(table), F.col("_n") <= F.col("window"))
    gap = F.col("r") - F.col("b")
    return met.groupBy("run", "window").agg(F.count("r").alias("periods"), F.avg("r").alias("mean"), (safe_div(F.avg("r"), F.stddev_samp("r")) * a_year**0.5).alias("sharpe"), (safe_div(F.avg(gap), F.stddev_samp(gap)) * a_year**0.5).alias("information_ratio"), F.avg("turnover").alias("turnover"))
