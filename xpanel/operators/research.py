"""Tables of runs, exposures and disclosures: relational work over small tables and grouped work over large ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import expected_max_sharpe, probabilistic_sharpe, safe_div
from .joins import mapped

# The six styles.
STYLES = ("size", "value", "quality", "momentum", "low_vol", "beta")


def styles(held: DataFrame, universe: DataFrame, names: Sequence[str] = STYLES, cap: str = "cap") -> DataFrame:
    """trade_date, factor and exposures of signed holdings (trade_date, symbol, weight) to the styles of a universe.

    Each style is a z-score within the date; portfolio_long, _short and _gross are means under absolute weights, _net sums signed ones; the
    universe's means are equal and by cap. weight_coverage is the share of absolute weight with a known style. The styles are
    one long table, so a date and style is one group of one exchange.
    """
    long = universe.unpivot(["trade_date", "symbol", cap], list(names), "factor", "x").filter("x is not null")
    day = Window.partitionBy("trade_date", "factor")
    z = long.withColumn("z", safe_div(F.col("x") - F.avg("x").over(day), F.stddev_pop("x").over(day))).filter("z is not null")
    z = z.withColumn("_cap", F.when(F.col(cap) > 0, F.col(cap)))
    w = held.groupBy("trade_date", "symbol").agg(F.sum("weight").alias("w"))
    total = w.groupBy("trade_date").agg(F.sum(F.abs("w")).alias("_total"), F.count(F.lit(1)).alias("n_holdings"))
    both = z.join(w, ["trade_date", "symbol"], "left")
    size, known = F.abs("w"), F.col("w")
    mean = lambda c: safe_div(F.sum(F.when(c, size * F.col("z"))), F.sum(F.when(c, size)))
    made = both.groupBy("trade_date", "factor").agg(
        F.count(F.lit(1)).alias("n_universe"), mean(known > 0).alias("portfolio_long"), mean(known < 0).alias("portfolio_short"), F.sum(known * F.col("z")).alias("portfolio_net"), mean(known.isNotNull()).alias("portfolio_gross"),
        F.avg("z").alias("universe_equal"), safe_div(F.sum(F.col("_cap") * F.col("z")), F.sum("_cap")).alias("universe_cap_weight"), F.sum(size).alias("_covered"),
    )
    made = made.join(F.broadcast(total), "trade_date")  # a row for each date
    return made.select("trade_date", "factor", "n_universe", "n_holdings", F.coalesce(safe_div("_covered", "_total"), F.lit(0.0)).alias("weight_coverage"), "portfolio_long", "portfolio_short", "portfolio_net", "portfolio_gross", "universe_equal", "universe_cap_weight", (F.col("portfolio_net") - F.col("universe_equal")).alias("active_net_vs_equal"), (F.col("portfolio_net") - F.col("universe_cap_weight")).alias("active_net_vs_cap"))


def active_summary(style: DataFrame, industry: DataFrame, top: int = 3, names: Sequence[str] = STYLES) -> DataFrame:
    """One wide row a date: each style's active exposures and coverage, and the industries of largest absolute active weight.

    style as from styles; industry: trade_date, industry, portfolio, active. Ties of industries go by name.
    """
    wide = style.groupBy("trade_date").pivot("factor", list(names)).agg(F.first("active_net_vs_equal").alias("active_net_vs_equal"), F.first("active_net_vs_cap").alias("active_net_vs_cap"), F.first("weight_coverage").alias("weight_coverage"))
    placed = industry.withColumn("_k", F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc(F.abs("active")), "industry"))).filter(F.col("_k") <= top)
    at = lambda c, k: F.max(F.when(F.col("_k") == k, F.col(c)))
    best = placed.groupBy("trade_date").agg(*(at(c, k).alias(f"industry_top_{k}_{n}") for k in range(1, top + 1) for c, n in (("industry", "name"), ("active", "active"), ("portfolio", "portfolio_net_weight"))))
    return wide.join(best, "trade_date", "full_outer")


def ranked_runs(runs: DataFrame, by: str = "score") -> DataFrame:
    """runs with place: by score, dsr or timestamp, largest first and nulls last, then by name. A row a run."""
    if by not in ("score", "dsr", "timestamp"):
        raise ValueError(f"unknown order {by!r}")
    return runs.withColumn("place", F.row_number().over(Window.orderBy(F.col(by).desc_nulls_last(), "run")))


def flagged_runs(runs: DataFrame, least_periods: int = 12, high_turnover: float = 0.8, deep: float = -0.4, weights: dict[str, float] | None = None) -> DataFrame:
    """runs (periods, ic, sharpe, turnover, max_drawdown) with flags and score, a weighted sum of their figures (null counts as 0)."""
    weights = weights or {"ic": 10.0, "sharpe": 1.0, "turnover": -0.5, "max_drawdown": 1.0}
    flag = lambda c: F.coalesce(c, F.lit(False))
    made = runs.withColumns({"flag_short": flag(F.col("periods") < least_periods), "flag_turnover": flag(F.col("turnover") > high_turnover), "flag_drawdown": flag(F.col("max_drawdown") < deep), "flag_negative_ic": flag(F.col("ic") < 0)})
    score = F.lit(0.0)
    for c, w in weights.items():
        score = score + w * F.coalesce(F.col(c), F.lit(0.0))
    return made.withColumn("score", score)


def filtered_runs(runs: DataFrame, prefix: str = "", since: str | None = None, without: Sequence[str] = ()) -> DataFrame:
    """runs whose name has the prefix, of that date or later, with none of the flags."""
    keep = F.col("run").startswith(prefix)
    if since:
        keep = keep & (F.col("timestamp") >= F.lit(since).cast("timestamp"))
    for flag in without:
        keep = keep & ~F.coalesce(F.col(f"flag_{flag}"), F.lit(False))
    return runs.filter(keep)


def cohort_statistics(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """runs with their cohort's trials, variance of Sharpe ratios and the deflated Sharpe ratio; null for fewer than two trials.

    runs: sharpe (a period), periods, skew, kurtosis. A null key is a value of its own.
    """
    w = Window.partitionBy(*(F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys))
    made = runs.withColumns({"trials": F.count("sharpe").over(w), "sharpe_variance": F.var_samp("sharpe").over(w)})
    best = F.when(F.col("trials") > 1, expected_max_sharpe("trials", "sharpe_variance"))
    return made.withColumn("expected_max", best).withColumn("dsr", probabilistic_sharpe("sharpe", "expected_max", "periods", "skew", "kurtosis"))


def promotion(pairs: DataFrame, evidence: Sequence[str], keys: Sequence[str], hard: dict[str, float], soft: dict[str, float]) -> DataFrame:
    """pairs of a baseline (columns b_...) and a candidate (c_...) with verdict and reasons.

    keys must agree, else non_comparable; all evidence columns must be there and hard floors met, else rejected; the candidate may fall
    behind by at most the soft margins, else reviewable; what is left is promotable.
    """
    tell = lambda pairs_: F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in pairs_)), lambda x: x.isNotNull()) if pairs_ else F.array().cast("array<string>")
    apart = tell([(f"differs:{k}", ~F.col(f"b_{k}").eqNullSafe(F.col(f"c_{k}"))) for k in keys])
    absent = tell([(f"missing:{e}", F.col(f"c_{e}").isNull()) for e in evidence])
    below = tell([(f"below:{n}", F.coalesce(F.col(f"c_{n}") < v, F.lit(True))) for n, v in hard.items()])
    behind = tell([(f"behind:{n}", F.coalesce(F.col(f"c_{n}") < F.col(f"b_{n}") - v, F.lit(True))) for n, v in soft.items()])
    made = pairs.withColumns({"_a": apart, "_m": F.concat(absent, below), "_s": behind})
    verdict = F.when(F.size("_a") > 0, "non_comparable").when(F.size("_m") > 0, "rejected").when(F.size("_s") > 0, "reviewable").otherwise("promotable")
    return made.withColumns({"verdict": verdict, "reasons": F.array_join(F.concat("_a", "_m", "_s"), ",")}).drop("_a", "_m", "_s")


def quality_verdict(issues: DataFrame, fail_on: str = "error", by: Sequence[str] = ("run",)) -> DataFrame:
    """by, issues, worst severity, colour and passed: whether nothing is as severe as fail_on (info, warning, error). Unknown severities count as error."""
    order = F.when(F.col("severity") == "info", 1).when(F.col("severity") == "warning", 2).otherwise(3)
    floor = {"info": 1, "warning": 2, "error": 3}[fail_on]
    made = issues.groupBy(*by).agg(F.count("severity").alias("issues"), F.max(F.when(F.col("severity").isNotNull(), order)).alias("_w"))
    name = F.when(F.col("_w") == 3, "error").when(F.col("_w") == 2, "warning").when(F.col("_w") == 1, "info")
    colour = F.when(F.col("_w") == 3, "red").when(F.col("_w") == 2, "yellow").otherwise("green")
    return made.select(*by, "issues", name.alias("worst"), colour.alias("colour"), (F.coalesce("_w", F.lit(0)) < floor).alias("passed"))


def subject_frequency(rows: DataFrame, keys: Sequence[str], symbol: str = "symbol") -> DataFrame:
    """keys with rows and different symbols."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(symbol).alias("symbols"))


def normalization_gain(rows: DataFrame, field: str, raw: str, normal: str) -> DataFrame:
    """By field: different raw and normalised subjects, and how many fewer there are."""
    made = rows.groupBy(field).agg(F.countDistinct(raw).alias("raw"), F.countDistinct(normal).alias("normal"))
    return made.withColumn("merged", F.col("raw") - F.col("normal"))


def probe_coverage(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Every asked symbol with its rows, fields and first and last quarter; 0 and nulls if there are none."""
    made = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("field").alias("fields"), F.min("quarter").alias("first_quarter"), F.max("quarter").alias("last_quarter"))
    both = asked.select("symbol").distinct().join(made, "symbol", "left")
    return both.withColumns({"rows": F.coalesce("rows", F.lit(0)), "fields": F.coalesce("fields", F.lit(0))})


def details_report(rows: DataFrame, rules: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The whole analysis of a probe of financial details: one row for each field and normalised subject.

    rows: symbol, field, subject, quarter, info_date, amount. rules: field, subject, normal, a row for each rule; other subjects keep their name.
    Of one symbol's disclosures of a subject in a quarter the last counts (latest_rows and latest_amount), the others are repeats. is_new:
    an earlier probe (before, of the same columns) has no such field and subject; null without one. One exchange by disclosure key serves the
    flags, one by subject the sums.
    """
    normal = lambda df: mapped(df, F.broadcast(rules), ["field", "subject"], "subject", "normal")
    made = normal(rows)
    last = F.row_number().over(Window.partitionBy("symbol", "field", "normal", "quarter").orderBy(F.desc("info_date"), F.desc("amount"))) == 1
    report = made.withColumn("_last", last).groupBy("field", "normal").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("_last").alias("latest_rows"), F.count_if(~F.col("_last")).alias("repeats"), F.countDistinct("symbol").alias("symbols"), F.countDistinct("subject").alias("raw_subjects"),
        F.min("quarter").alias("first_quarter"), F.max("quarter").alias("last_quarter"), F.sum(F.when(F.col("_last"), F.col("amount"))).alias("latest_amount"),
    )
    if before is None:
        return report.withColumn("is_new", F.lit(None).cast("boolean"))
    known = normal(before).select("field", "normal").distinct().withColumn("_known", F.lit(True))
    return report.join(known, ["field", "normal"], "left").withColumn("is_new", F.col("_known").isNull()).drop("_known")


def disclosures(rows: DataFrame, keys: Sequence[str], date: str, value: str) -> DataFrame:
    """keys that are disclosed more than once: how often, first and last date, different values."""
    made = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.countDistinct(value).alias("amounts"))
    return made.filter("n > 1")


def split_paths(splits: DataFrame, paths: DataFrame, by: str = "split") -> DataFrame:
    """path figures from those of its splits' test groups: splits (split, grp, ic, n), paths (path, grp, split)."""
    both = splits.join(F.broadcast(paths), [by, "grp"])  # a row for each group of each path
    return both.groupBy("path").agg(F.count("ic").alias("groups"), safe_div(F.sum(F.col("ic") * F.col("n")), F.sum("n")).alias("ic"))


def spread_of(c: str) -> list[Column]:
    """Aggregates: the count, mean, deviation and outer percentiles of a column, and the share above 0."""
    return [F.count(c).alias("paths"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), *(F.percentile(c, p).alias(f"p{round(100 * p)}") for p in (0.05, 0.5, 0.95)), F.avg((F.col(c) > 0).cast("double")).alias("positive")]


def ablations(df: DataFrame, runs: dict[str, dict[str, float]], base: str, k: int, t: str = "t") -> DataFrame:
    """run, mean_return of the top k by each run's linear score (feature to weight; null counts as 0), and its delta from the base run.

    All runs are labels of the same rows, so one ranking by run and date serves them. Scores are compared to nine digits.
    """
    score = lambda ws: F.round(sum((w * F.coalesce(F.col(f), F.lit(0.0)) for f, w in ws.items()), F.lit(0.0)), 9)
    stack = F.explode(F.array(*(F.struct(F.lit(n).alias("run"), score(ws).alias("score")) for n, ws in runs.items())))
    long = df.select("trade_date", "symbol", t, stack.alias("x")).select("trade_date", "symbol", t, "x.*")
    place = F.row_number().over(Window.partitionBy("run", "trade_date").orderBy(F.desc("score"), "symbol"))
    each = long.withColumn("_k", place).filter(F.col("_k") <= k).groupBy("run", "trade_date").agg(F.avg(t).alias("r")).groupBy("run").agg(F.avg("r").alias("mean_return"))
    full = each.filter(F.col("run") == base).select(F.col("mean_return").alias("_base"))  # one row
    return each.crossJoin(F.broadcast(full)).select("run", "mean_return", (F.col("mean_return") - F.col("_base")).alias("delta"))


def permutation_drops(df: DataFrame, families: dict[str, Sequence[str]], weights: dict[str, float], k: int, t: str = "t", seed: int = 1) -> DataFrame:
    """family, mean_return of the top k by a linear score whose family's features are dealt anew within each date, and its drop from the base.

    Features are dealt by a seeded hash of the symbol, all families in one plan: a family is a label of the ranked rows.
    """
    day = Window.partitionBy("trade_date")
    own = F.row_number().over(day.orderBy("symbol"))
    dealt = F.row_number().over(day.orderBy(F.xxhash64(F.lit(seed), "symbol"), "symbol"))
    a = df.select("trade_date", "symbol", t, *weights, own.alias("_i"))
    b = df.select("trade_date", *(F.col(f).alias(f"_{f}") for f in weights), dealt.alias("_i"))
    both = a.join(b, ["trade_date", "_i"])
    score = lambda mine: sum((w * F.coalesce(F.col(f"_{f}" if f in mine else f), F.lit(0.0)) for f, w in weights.items()), F.lit(0.0))
    named = {"base": (), **families}
    stack = F.explode(F.array(*(F.struct(F.lit(n).alias("family"), score(f).alias("score")) for n, f in named.items())))
    long = both.select("trade_date", "symbol", t, stack.alias("x")).select("trade_date", "symbol", t, "x.*")
    place = F.row_number().over(Window.partitionBy("family", "trade_date").orderBy(F.desc("score"), "symbol"))
    each = long.withColumn("_k", place).filter(F.col("_k") <= k).groupBy("family", "trade_date").agg(F.avg(t).alias("r")).groupBy("family").agg(F.avg("r").alias("mean_return"))
    base = each.filter("family = 'base'").select(F.col("mean_return").alias("_base"))  # one row
    return each.crossJoin(F.broadcast(base)).select("family", "mean_return", (F.col("_base") - F.col("mean_return")).alias("drop"))
