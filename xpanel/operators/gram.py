"""Ridge regressions for many windows, folds, splits and penalties from one pass over the rows.

Each date's products of (1, features, label) are summed once. What a model is fitted on is a set of dates, so its sums are those of its
dates: differences of running sums for a range of dates, or all dates less the left-out ones. A model is then the solution of a few
linear equations, a fold of row operations in expressions. All models of a report are rows of one table and are scored in one plan.
Tables of sums have a row for each date, or for each date of each window or split; rows of the panel are read once.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import average_rank, correlation
from .splits import Split

RANKED = 2_000_000  # rows of a date in all splits that a task ranks together, some 100 bytes each
DIGITS = 10  # predictions are compared to so many digits, so that ranks do not depend on the order of sums


def complete(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    ok = F.lit(True)
    for c in (*features, label):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    return df.filter(ok)


def daily_sums(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None) -> DataFrame:
    """trade_date and m, the sums of the products of any two of (1, features, label), of complete rows; by weight, if there is one."""
    v = [F.lit(1.0), *(F.col(f).cast("double") for f in features), F.col(label).cast("double")]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    products = [F.sum(w * v[i] * v[j]) for i in range(len(v)) for j in range(i, len(v))]
    return complete(df, features, label).groupBy("trade_date").agg(F.array(*products).alias("m"))


def _each(m: str, size: int, make) -> Column:  # noqa: ANN001
    return F.array(*(make(F.col(m)[i]) for i in range(size)))


def _size(features: Sequence[str]) -> int:
    return (len(features) + 2) * (len(features) + 3) // 2


def range_sums(daily: DataFrame, cal: DataFrame, ranges: DataFrame, features: Sequence[str]) -> DataFrame:
    """ranges (its keys, lo, hi) with m over the dates whose index lies in [lo, hi): a running sum less another one."""
    n = _size(features)
    order = Window.orderBy("idx")  # a row for each date
    run = cal.join(daily, "trade_date", "left").select("idx", _each("m", n, lambda x: F.coalesce(F.sum(x).over(order), F.lit(0.0))).alias("_s"))
    first = cal.sparkSession.range(1).select(F.lit(-1).alias("idx"), F.array(*[F.lit(0.0)] * n).alias("_s"))
    run = run.select(F.col("idx").cast("int"), "_s").unionByName(first.select(F.col("idx").cast("int"), "_s"))
    hi, lo = run.select((F.col("idx") + 1).alias("hi"), F.col("_s").alias("_hi")), run.select((F.col("idx") + 1).alias("lo"), F.col("_s").alias("_lo"))
    return ranges.filter("lo < hi").join(hi, "hi").join(lo, "lo").withColumn("m", F.zip_with("_hi", "_lo", lambda a, b: a - b)).drop("_hi", "_lo")


def left_over(daily: DataFrame, out: DataFrame, keys: DataFrame, features: Sequence[str]) -> DataFrame:
    """keys (one column) with m over all dates but those that out (key, trade_date) names."""
    n, [key] = _size(features), keys.columns
    all_ = daily.agg(_each("m", n, F.sum).alias("_all"))  # one row
    gone = out.join(daily, "trade_date").groupBy(key).agg(_each("m", n, F.sum).alias("_gone"))
    both = keys.join(gone, key, "left").crossJoin(F.broadcast(all_))
    return both.select(key, F.when(F.col("_gone").isNull(), F.col("_all")).otherwise(F.zip_with("_all", "_gone", lambda a, b: a - b)).alias("m"))


def solved(sums: DataFrame, features: Sequence[str], alphas: Sequence[float] = (1.0,)) -> DataFrame:
    """sums with alpha, rows, beta and intercept: least squares with an intercept and alpha times the sum of squared slopes.

    Null where there are no rows or the equations have no single solution.
    """
    p, at, k = len(features), {}, 0
    for i in range(p + 2):
        for j in range(i, p + 2):
            at[i, j], k = k, k + 1
    m = lambda i, j: F.col("m")[at[min(i, j), max(i, j)]]
    centred = lambda i, j: m(i, j) - F.try_divide(m(0, i) * m(0, j), m(0, 0))
    table = F.array(*(F.array(*(centred(i, j) + (F.col("alpha") if i == j else F.lit(0.0)) for j in range(1, p + 1)), centred(i, p + 1)) for i in range(1, p + 1)))

    def eliminate(a: Column, k: Column) -> Column:
        pivot = F.get(a, k)
        head = F.get(pivot, k)
        head = F.when(F.abs(head) > 1e-12, head)
        return F.transform(a, lambda row, i: F.when(i == k, F.transform(pivot, lambda x: x / head)).otherwise(F.zip_with(row, pivot, lambda x, y: x - F.get(row, k) * y / head)))

    made = sums.withColumn("alpha", F.explode(F.array(*(F.lit(float(a)) for a in alphas)))).withColumn("_t", table)
    made = made.withColumn("_x", F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), F.col("_t"), eliminate))
    made = made.withColumn("beta", F.transform("_x", lambda row: F.get(row, F.lit(p))))
    slopes = sum((F.get("beta", F.lit(i)) * m(0, i + 1) for i in range(p)), F.lit(0.0))
    return made.withColumns({"rows": m(0, 0), "intercept": F.try_divide(m(0, p + 1) - slopes, m(0, 0))}).drop("_t", "_x", "m")


def elastic(sums: DataFrame, features: Sequence[str], settings: Sequence[tuple[float, float]], sweeps: int = 100) -> DataFrame:
    """sums with alpha, l1_ratio, rows, beta and intercept: half the mean squared error, plus alpha times l1_ratio |b| and (1 - l1_ratio) / 2 b^2.

    Coordinate descent on the centred sums, a fold of so many sweeps over the features.
    """
    p, at, k = len(features), {}, 0
    for i in range(p + 2):
        for j in range(i, p + 2):
            at[i, j], k = k, k + 1
    m = lambda i, j: F.col("m")[at[min(i, j), max(i, j)]]
    cov = lambda i, j: F.try_divide(m(i, j), m(0, 0)) - F.try_divide(m(0, i), m(0, 0)) * F.try_divide(m(0, j), m(0, 0))
    made = sums.withColumn("_s", F.explode(F.array(*(F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(r)).alias("l1_ratio")) for a, r in settings)))).select("*", "_s.*").drop("_s")
    made = made.withColumns({"_c": F.array(*(F.array(*(cov(i, j) for j in range(1, p + 1))) for i in range(1, p + 1))), "_y": F.array(*(cov(i, p + 1) for i in range(1, p + 1)))})

    def move(b: Column, step: Column) -> Column:
        j = step % p
        row = F.get("_c", j)
        fitted = F.aggregate(F.zip_with(row, b, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y) - F.get(row, j) * F.get(b, j)
        rest = F.get("_y", j) - fitted
        new = F.signum(rest) * F.greatest(F.abs(rest) - F.col("alpha") * F.col("l1_ratio"), F.lit(0.0)) / (F.get(row, j) + F.col("alpha") * (1 - F.col("l1_ratio")))
        return F.transform(b, lambda x, i: F.when(i == j, new).otherwise(x))

    made = made.withColumn("beta", F.aggregate(F.sequence(F.lit(0), F.lit(sweeps * p - 1)), F.array(*[F.lit(0.0)] * p), move))
    slopes = sum((F.get("beta", F.lit(i)) * m(0, i + 1) for i in range(p)), F.lit(0.0))
    return made.withColumns({"rows": m(0, 0), "intercept": F.try_divide(m(0, p + 1) - slopes, m(0, 0))}).drop("_c", "_y", "m")


def scored(df: DataFrame, models: DataFrame, features: Sequence[str]) -> DataFrame:
    """df with every model's columns and pred; models are few and broadcast. Rows with a missing feature have a null pred."""
    both = df.crossJoin(F.broadcast(models)) if not set(df.columns) & set(models.columns) else df.join(F.broadcast(models), list(set(df.columns) & set(models.columns)))
    pred = F.col("intercept")
    for i, f in enumerate(features):
        pred = pred + F.get("beta", F.lit(i)) * F.col(f)
    return both.withColumn("pred", F.round(pred, DIGITS)).drop("beta", "intercept")


def _ranges(spark: SparkSession, windows: Sequence[Split]) -> DataFrame:
    rows = [(i, role, lo, hi) for i, w in enumerate(windows) for role, (lo, hi) in (("train", w.train), ("test", w.test))]
    return spark.createDataFrame(rows, "window int, role string, lo int, hi int")


def window_scores(df: DataFrame, cal: DataFrame, windows: Sequence[Split], features: Sequence[str], label: str, alphas: Sequence[float] = (1.0,), weight: str | None = None) -> DataFrame:
    """The rows of every window's training and test dates (window, role, alpha, pred and the columns of df), scored by that window's models."""
    ranges = _ranges(df.sparkSession, windows)
    sums = range_sums(daily_sums(df, features, label, weight), cal, ranges.filter("role = 'train'").drop("role"), features)
    models = solved(sums, features, alphas).drop("lo", "hi", "rows")
    dated = cal.join(F.broadcast(ranges), (F.col("idx") >= F.col("lo")) & (F.col("idx") < F.col("hi"))).select("trade_date", "window", "role")
    return scored(complete(df, features, label).join(F.broadcast(dated), "trade_date"), models, features)  # a row for each date of each window


def directed(rows: DataFrame, label: str, by: Sequence[str], mode: str, fixed: float = 1.0, flip_below: float = 0.0, ranked: str | None = None) -> DataFrame:
    """by, train_ic, direction: as given, or by the sign of the mean daily IC of pred on the training rows (role train). ranked: a column with the label's ranks, if there is one."""
    if mode not in ("fixed", "train_ic"):
        raise ValueError(f"unknown mode {mode!r}")
    keys = (*by, "trade_date")
    train = rows.filter("role = 'train'").select(*keys, average_rank("pred", *keys).alias("a"), (F.col(ranked) if ranked else average_rank(label, *keys)).alias("b"))
    ic = train.groupBy(*keys).agg(correlation("a", "b").alias("ic")).groupBy(*by).agg(F.avg("ic").alias("train_ic"))
    sign = F.lit(float(fixed)) if mode == "fixed" else F.when(F.col("train_ic") < flip_below, -fixed).otherwise(fixed)
    return ic.withColumn("direction", sign)


def daily_report(rows: DataFrame, label: str, by: Sequence[str], k: int, q: int = 5, ranked: str | None = None) -> DataFrame:
    """by, trade_date with every daily figure of signal against the label, from one ranking of each date.

    ic, pearson, hits and absolute errors (of pred), the label's mean over the first and last of q buckets, and of the k best names
    their number, mean label, share of positive labels and set. ranked: a column with the label's ranks, if there is one.
    """
    keys = (*by, "trade_date")
    day = Window.partitionBy(*keys)
    up = F.row_number().over(day.orderBy("signal", "symbol"))
    n = F.count(F.lit(1)).over(day)
    ranked = rows.withColumns({"_a": average_rank("signal", *keys), "_b": F.col(ranked) if ranked else average_rank(label, *keys), "_p": up, "_n": n, "_k": F.row_number().over(day.orderBy(F.desc("signal"), "symbol"))})
    bucket = F.when(F.col("_n") >= q, F.greatest(F.lit(0), F.ceil((F.col("_p") - 1) * q / (F.col("_n") - 1)) - 1))
    top = F.col("_k") <= k
    return ranked.groupBy(*keys).agg(
        correlation("_a", "_b").alias("ic"), correlation("signal", label).alias("pearson"), F.sum((F.signum("pred") == F.signum(label)).cast("long")).alias("hits"), F.sum(F.abs(F.col("pred") - F.col(label))).alias("gap"), F.count(F.lit(1)).alias("rows"),
        *(F.avg(F.when(bucket == b, F.col(label))).alias(f"bucket_{b}") for b in (0, q - 1)),
        F.avg(F.when(top, F.col(label))).alias("top_mean"), F.avg(F.when(top, (F.col(label) > 0).cast("double"))).alias("top_positive"), F.array_sort(F.collect_list(F.when(top, F.col("symbol")))).alias("names"),
    )


def summed_report(daily: DataFrame, by: Sequence[str], k: int, q: int = 5, bps: float = 0.0) -> DataFrame:
    """by with a report's figures: IC mean, deviation and ratio, Pearson, long-short, hit rate, MAE, turnover, positive share, and a top-k backtest.

    A period's return is the mean label of its k names, equally weighted. Turnover is the share of names that were not held at the
    date before; the fee is bps of the first purchase and of both sides of the turnover after it.
    """
    w = Window.partitionBy(*by).orderBy("trade_date")
    before = F.lag("names").over(w)
    turnover = F.when(before.isNotNull(), 1 - F.size(F.array_intersect("names", before)) / F.size("names"))
    moved = daily.withColumn("turnover", turnover)
    net = F.col("top_mean") - F.when(F.col("turnover").isNull(), 1.0).otherwise(2 * F.col("turnover")) * bps / 1e4
    made = moved.withColumn("net", net).groupBy(*by).agg(
        F.min("trade_date").alias("test_start"), F.max("trade_date").alias("test_end"), F.count("ic").alias("ic_n"), F.avg("ic").alias("test_ic"), F.stddev_pop("ic").alias("ic_std"), F.avg("pearson").alias("pearson_ic"),
        (F.avg(f"bucket_{q - 1}") - F.avg("bucket_0")).alias("long_short"), (F.sum("hits") / F.sum("rows")).alias("hit_rate"), (F.sum("gap") / F.sum("rows")).alias("mae"),
        F.avg("turnover").alias("turnover"), F.avg("top_positive").alias("topk_positive"), F.count("net").alias("periods"), F.avg("top_mean").alias("mean_gross"), F.avg("net").alias("mean_net"), (F.product(1 + F.col("net")) - 1).alias("total_net"),
    )
    return made.withColumn("ic_ir", F.try_divide("test_ic", "ic_std"))


def walk_forward(df: DataFrame, cal: DataFrame, windows: Sequence[Split], features: Sequence[str], label: str, alpha: float = 1.0, mode: str = "train_ic", k: int = 5, q: int = 5, bps: float = 0.0) -> DataFrame:
    """One row for each window with all figures of its test dates, its direction and status; all windows are labels of one plan."""
    by = ["window"]
    rows = window_scores(df, cal, windows, features, label, (alpha,))
    sign = directed(rows, label, by, mode)
    test = rows.filter("role = 'test'").join(F.broadcast(sign), "window").withColumn("signal", F.col("pred") * F.col("direction"))  # a row for each window
    made = summed_report(daily_report(test, label, by, k, q), by, k, q, bps).join(sign, "window")
    every = df.sparkSession.createDataFrame([(i,) for i in range(len(windows))], "window int")
    return every.join(made, "window", "left").withColumn("status", F.when(F.col("periods") > 0, "ok").otherwise("insufficient_data"))


def folds(df: DataFrame, cal: DataFrame, windows: Sequence[Split], features: Sequence[str], label: str, alpha: float = 1.0, flip_below: float = 0.0) -> DataFrame:
    """fold, ic (mean daily IC of its test dates) and direction, by the sign of the folds' mean."""
    rows = window_scores(df, cal, windows, features, label, (alpha,)).filter("role = 'test'")
    each = _mean_ic(rows, label, ["window"])
    every = df.sparkSession.createDataFrame([(i,) for i in range(len(windows))], "fold int")
    made = every.join(each.withColumnRenamed("window", "fold"), "fold", "left")
    mean = F.avg("ic").over(Window.partitionBy())  # a row for each fold
    return made.withColumn("direction", F.when(mean < flip_below, -1.0).otherwise(1.0))


def _mean_ic(rows: DataFrame, label: str, by: Sequence[str]) -> DataFrame:
    keys = (*by, "trade_date")
    ranks = rows.select(*keys, average_rank("pred", *keys).alias("a"), average_rank(label, *keys).alias("b"))
    return ranks.groupBy(*keys).agg(correlation("a", "b").alias("ic")).groupBy(*by).agg(F.avg("ic").alias("ic"))


def sweep(df: DataFrame, cal: DataFrame, split: Split, features: Sequence[str], label: str, alphas: Sequence[float], l1_ratios: Sequence[float] = ()) -> DataFrame:
    """kind, alpha, l1_ratio, ic: ridge for each alpha and elastic net for each pair, all fitted on one table of sums, judged on the test dates."""
    spark = df.sparkSession
    ranges = spark.createDataFrame([(*split.train,)], "lo int, hi int")
    sums = range_sums(daily_sums(df, features, label), cal, ranges, features)
    ridge = solved(sums, features, alphas).select(F.lit("ridge").alias("kind"), "alpha", F.lit(0.0).alias("l1_ratio"), "beta", "intercept")
    models = ridge
    if l1_ratios:
        models = ridge.unionByName(elastic(sums, features, [(a, r) for a in alphas for r in l1_ratios]).select(F.lit("elasticnet").alias("kind"), "alpha", "l1_ratio", "beta", "intercept"))
    test = cal.filter((F.col("idx") >= split.test[0]) & (F.col("idx") < split.test[1])).select("trade_date")
    rows = scored(complete(df, features, label).join(F.broadcast(test), "trade_date", "left_semi"), models, features)  # a row for each date
    return _mean_ic(rows, label, ["kind", "alpha", "l1_ratio"])


def latest(df: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0) -> DataFrame:
    """trade_date, symbol, pred, place of the last date's rows, by a ridge fitted on all dates before it that have labels. An empty table gives no rows."""
    known = df.agg(F.max("trade_date").alias("trade_date"))  # one row
    now = df.join(F.broadcast(known), "trade_date", "left_semi")
    past = daily_sums(df, features, label).join(F.broadcast(known.withColumnRenamed("trade_date", "_last")), F.col("trade_date") < F.col("_last")).drop("_last")
    models = solved(past.agg(_each("m", _size(features), F.sum).alias("m")), features, (alpha,)).drop("alpha", "rows")
    place = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("pred"), "symbol"))
    return scored(now, models, features).select("trade_date", "symbol", "pred", place.alias("place"))


# ---- combinatorial splits


def purge_pairs(dates: DataFrame, windows: DataFrame, embargo_days: int = 0) -> DataFrame:
    """grp, trade_date, overlap, embargoed: whether a date's label window meets one of the group's, and whether it follows the end of one within the embargo.

    dates: trade_date, grp. windows: trade_date, start, stop (dates without one are not in it). Of a group's windows that start before a
    date's own ends, the one that ends last decides; of those that end before a date, the last one. Both are running
    maxima over a row for each group and date.
    """
    groups = dates.select("grp").distinct()
    known = windows.filter("start is not null and stop is not null")
    known = known.select("trade_date", F.least("start", "stop").alias("start"), F.greatest("start", "stop").alias("stop"))
    tests = dates.join(known, "trade_date").select("grp", "start", "stop")
    asked = groups.crossJoin(F.broadcast(known))
    none = F.lit(None).cast("date")
    shape = lambda df, key, value, ask, date, start: df.select("grp", key.alias("key"), value.alias("value"), F.lit(ask).alias("ask"), date.alias("trade_date"), start.alias("start"))
    met = shape(tests, F.col("start"), F.col("stop"), 0, none, none).unionByName(shape(asked, F.col("stop"), none, 1, F.col("trade_date"), F.col("start")))
    last = F.max("value").over(Window.partitionBy("grp").orderBy("key", "ask").rowsBetween(Window.unboundedPreceding, 0))
    over = met.withColumn("_last", last).filter("ask = 1").select("grp", "trade_date", F.coalesce(F.col("_last") >= F.col("start"), F.lit(False)).alias("overlap"))
    ends = shape(tests, F.col("stop"), F.col("stop"), 1, none, none).unionByName(shape(asked, F.col("trade_date"), none, 0, F.col("trade_date"), none))
    late = ends.withColumn("_last", last).filter("ask = 0").select("grp", "trade_date", F.coalesce(F.col("trade_date") <= F.date_add("_last", embargo_days), F.lit(False)).alias("embargoed"))
    return over.join(late, ["grp", "trade_date"])


def cpcv_roles(dates: DataFrame, groups: int, tests: int, windows: DataFrame | None = None, embargo_days: int = 0, gap_steps: int = 0) -> DataFrame:
    """split, trade_date, grp, role (train, test, purged, embargoed), purge_mode for every combinatorial split.

    With label windows for all of a split's test dates, training dates whose windows overlap or are unknown are purged and those within
    the embargo left out. Otherwise dates within gap_steps of the stretch from the first to the last test date are.
    dates: trade_date, grp from 0.
    """
    table = [(i, g, g in c) for i, c in enumerate(combinations(range(groups), tests)) for g in range(groups)]
    splits = dates.sparkSession.createDataFrame(table, "split int, grp int, is_test boolean")  # a row for each split and group
    at = dates.select("trade_date", F.col("grp").cast("int").alias("grp"), (F.row_number().over(Window.orderBy("trade_date")) - 1).alias("idx"))
    rows = at.join(F.broadcast(splits), "grp")
    by = Window.partitionBy("split")
    hull = [f(F.when(F.col("is_test"), F.col("idx"))).over(by) for f in (F.min, F.max)]
    near = F.col("idx").between(hull[0] - gap_steps, hull[1] + gap_steps) if gap_steps > 0 else F.lit(False)
    if windows is None:
        role = F.when(F.col("is_test"), "test").when(near, "purged").otherwise("train")
        return rows.select("split", "trade_date", "grp", role.alias("role"), F.lit("fallback_gap" if gap_steps > 0 else "none").alias("purge_mode"))
    known = windows.filter("start is not null and stop is not null").select("trade_date", F.lit(True).alias("_known")).distinct()
    pairs = purge_pairs(at.select("trade_date", "grp"), windows, embargo_days)
    tested = splits.filter("is_test").select("split", F.col("grp").alias("_g"))
    hit = pairs.withColumnRenamed("grp", "_g").join(F.broadcast(tested), "_g").groupBy("split", "trade_date").agg(F.bool_or("overlap").alias("overlap"), F.bool_or("embargoed").alias("embargoed"))
    full = rows.join(known, "trade_date", "left").join(hit, ["split", "trade_date"], "left")
    whole = F.min(F.when(F.col("is_test"), F.col("_known").isNotNull().cast("int"))).over(by) == 1
    event = F.when(F.col("_known").isNull() | F.coalesce("overlap", F.lit(False)), "purged").when(F.coalesce("embargoed", F.lit(False)) & F.lit(embargo_days > 0), "embargoed").otherwise("train")
    role = F.when(F.col("is_test"), "test").when(whole, event).otherwise(F.when(near, "purged").otherwise("train"))
    return full.select("split", "trade_date", "grp", role.alias("role"), F.when(whole, "event_window").otherwise("fallback_gap").alias("purge_mode"))


def cpcv_days(df: DataFrame, roles: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0, mode: str = "train_ic", k: int = 5, least_dates: int = 1) -> DataFrame:
    """split, grp, trade_date and the daily figures of every split's test dates, each split refitted on its own training dates.

    A split's sums are those of all dates less its test, purged and embargoed ones. Splits of fewer than least_dates training dates are left out.
    A date's rows are ranked in every split. They are dealt by date and, if that is more than RANKED rows, by part of the splits, and meet their
    splits only in the task that ranks them, so a task holds about as many rows at any size; before they are copied for the parts they are dealt
    by date and symbol. Two tables are collected: sums, a row for each
    date, and roles, a row for each date of each split.
    """
    spark = df.sparkSession
    kept = complete(df, features, label).select("trade_date", "symbol", *dict.fromkeys((*features, label)))
    daily, roles = (spark.createDataFrame(x.collect(), x.schema) for x in (daily_sums(kept, features, label), roles.select("split", "trade_date", "grp", "role")))
    enough = roles.groupBy("split").agg(F.count_if(F.col("role") == "train").alias("n")).filter(F.col("n") >= least_dates).select("split")
    models = solved(left_over(daily, roles.filter("role <> 'train'").select("split", "trade_date"), enough, features), features, (alpha,)).drop("rows", "alpha")
    wanted = roles.filter("role in ('train', 'test')" if mode == "train_ic" else "role = 'test'")
    most, total = wanted.join(daily, "trade_date").groupBy("trade_date").agg(F.sum(F.col("m")[0]).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()
    parts, tasks = max(1, ceil(most / RANKED)), max(1, 2 * ceil(total / RANKED))
    if parts > 1:  # each row is written once a part, by tasks of bounded size too and not by the few that made the panel
        rows = daily.agg(F.sum(F.col("m")[0])).first()[0]
        kept = kept.repartition(ceil(parts * rows / RANKED), "trade_date", "symbol")
    dealt = kept.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(tasks, "trade_date", "_part")
    dealt = dealt.withColumn("_rank", average_rank(label, "trade_date", "_part"))  # the same in every split, as a split has all rows of a date or none
    rows = scored(dealt.join(F.broadcast(wanted.withColumn("_part", F.pmod("split", F.lit(parts)))), ["trade_date", "_part"]), models, features)  # a row for each date of each split
    if mode == "train_ic":
        rows = rows.join(F.broadcast(directed(rows, label, ["split", "_part"], mode, ranked="_rank")), ["split", "_part"])  # a row for each split
    else:
        rows = rows.withColumn("direction", F.lit(1.0))
    test = rows.filter("role = 'test'").withColumn("signal", F.col("pred") * F.col("direction"))
    return daily_report(test, label, ["split", "_part", "grp"], k, ranked="_rank").drop("_part")


def cpcv_paths(days: DataFrame, paths: DataFrame) -> DataFrame:
    """path, trade_date, split, ic, ret: each path takes every group's test days from one split. paths: path, grp, split."""
    return days.join(F.broadcast(paths), ["split", "grp"]).select("path", "trade_date", "split", "ic", F.col("top_mean").alias("ret"))


def path_figures(series: DataFrame, periods_per_year: float = 12.0) -> DataFrame:
    """path with its periods, mean IC, mean, deviation, total return, Sharpe ratio and largest drawdown."""
    order = Window.partitionBy("path").orderBy("trade_date")
    nav = series.withColumn("_nav", F.exp(F.sum(F.log1p("ret")).over(order)))
    nav = nav.withColumn("_fall", F.col("_nav") / F.greatest(F.max("_nav").over(order), F.lit(1.0)) - 1)
    made = nav.groupBy("path").agg(F.count("ret").alias("periods"), F.avg("ic").alias("ic"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"), (F.product(1 + F.col("ret")) - 1).alias("total_return"), F.min("_fall").alias("max_drawdown"))
    return made.withColumn("sharpe", F.try_divide("mean", "std") * periods_per_year**0.5)

