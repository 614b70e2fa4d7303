"""Queries about signal quality, splits and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import dates as D
from ..operators import models as M
from ..operators import signals as S
from ..operators import splits as P
from .panels import PM, SC, SUP, monthly, scored, suppliers
from .registry import query

R = 6
_IC = f"""{PM}, {SC}, rk AS (SELECT *, rank() OVER (PARTITION BY trade_date ORDER BY s) + (count(*) OVER (PARTITION BY trade_date, s) - 1) / 2.0 AS a, rank() OVER (PARTITION BY trade_date ORDER BY t) + (count(*) OVER (PARTITION BY trade_date, t) - 1) / 2.0 AS b FROM sc),
ic AS (SELECT trade_date, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS ic, count(*) AS n FROM rk GROUP BY trade_date HAVING stddev_pop(a) * stddev_pop(b) > 0)"""


def _round(df: DataFrame, *cs: str) -> DataFrame:
    return df.withColumns({c: F.round(c, R) for c in cs})


@query(f"WITH {_IC} SELECT trade_date, round(ic, 6) AS ic, n FROM ic")
def daily_ic_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(S.daily_ic(scored(spark, sf_dir)), "ic")


@query(f"WITH {PM}, {SC} SELECT trade_date, round(covar_pop(s, t) / nullif(stddev_pop(s) * stddev_pop(t), 0), 6) AS ic, count(*) AS n FROM sc GROUP BY trade_date HAVING stddev_pop(s) * stddev_pop(t) > 0")
def daily_ic_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(S.daily_ic(scored(spark, sf_dir), method="pearson"), "ic")


#: the probability of t by the finite series for whole degrees of freedom v, in powers of cos(atan(t / sqrt(v)))
_P_VALUE = """m AS (SELECT count(*) AS n, avg(ic) AS mean, stddev_pop(ic) AS std, avg(ic) / nullif(stddev_pop(ic) / sqrt(count(*)), 0) AS t FROM ic), th AS (SELECT n - 1 AS v, atan(abs(t) / sqrt(n - 1)) AS th FROM m),
ev AS (SELECT k, sum(CASE WHEN k = 0 THEN 0 ELSE ln((2 * k - 1) / (2.0 * k)) END) OVER (ORDER BY k) + 2 * k * ln(cos(th)) AS l FROM th, range(v // 2) AS x(k) WHERE v % 2 = 0),
od AS (SELECT k, sum(CASE WHEN k = 0 THEN 0 ELSE ln(2 * k / (2 * k + 1.0)) END) OVER (ORDER BY k) + (2 * k + 1) * ln(cos(th)) AS l FROM th, range((v - 1) // 2) AS x(k) WHERE v % 2 = 1),
pv AS (SELECT 1 - CASE WHEN v % 2 = 0 THEN sin(th) * (SELECT sum(exp(l)) FROM ev) ELSE 2 / pi() * (th + sin(th) * coalesce((SELECT sum(exp(l)) FROM od), 0)) END AS p FROM th)"""


@query(f"WITH {_IC}, {_P_VALUE} SELECT n, round(mean, 6) AS mean, round(std, 6) AS std, round(mean / nullif(std, 0), 6) AS ir, round(t, 5) AS t_stat, round(p, 6) AS p_value FROM m, pv")
def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = S.ic_summary(S.daily_ic(scored(spark, sf_dir)))
    return made.select("n", *(F.round(c, R).alias(c) for c in ("mean", "std", "ir", "p_value")), F.round("t_stat", 5).alias("t_stat"))


_QR = f"{PM}, {SC}, q AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY s, symbol) AS p, count(*) OVER (PARTITION BY trade_date) AS n FROM sc), qb AS (SELECT *, CAST(greatest(0, ceil((p - 1) * 5.0 / (n - 1)) - 1) AS INTEGER) AS bucket FROM q WHERE n >= 5), qr AS (SELECT trade_date, bucket, avg(t) AS mean_target FROM qb GROUP BY 1, 2)"


@query(f"WITH {_QR} SELECT trade_date, bucket, round(mean_target, 6) AS mean_target FROM qr")
def quantile_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(S.quantile_returns(scored(spark, sf_dir)), "mean_target")


@query(f"WITH {_QR} SELECT trade_date, round(max_by(mean_target, bucket) - min_by(mean_target, bucket), 6) AS spread FROM qr GROUP BY trade_date")
def long_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(S.long_short(scored(spark, sf_dir)), "spread")


@query(f"WITH {PM}, {SC} SELECT round(avg(abs(t - s)), 6) AS mae, round(sqrt(avg((t - s) * (t - s))), 6) AS rmse, round(1 - sum((t - s) * (t - s)) / nullif(var_pop(t) * count(t), 0), 5) AS r2, round(avg(CASE WHEN sign(s) = sign(t) THEN 1.0 ELSE 0 END), 6) AS hit_rate FROM sc")
def error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = S.errors(scored(spark, sf_dir))
    return made.select(F.round("mae", R).alias("mae"), F.round("rmse", R).alias("rmse"), F.round("r2", 5).alias("r2"), F.round("hit_rate", R).alias("hit_rate"))


_TOP = f"{PM}, {SC}, tp AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY s DESC, symbol) AS place, count(*) OVER (PARTITION BY trade_date) AS n FROM sc), top AS (SELECT * FROM tp WHERE place <= 5 AND n >= 5)"


@query(f"WITH {_TOP}, d AS (SELECT trade_date, avg(CASE WHEN t > 0 THEN 1.0 ELSE 0 END) AS share FROM top GROUP BY 1) SELECT round(avg(share), 6) AS topk_positive, count(*) AS n_dates FROM d")
def topk_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(S.topk_positive(scored(spark, sf_dir), 5), "topk_positive")


@query(f"""WITH {_TOP}, h AS (SELECT trade_date, list(symbol) AS names FROM top GROUP BY 1), l AS (SELECT trade_date, names, lag(names) OVER (ORDER BY trade_date) AS prev FROM h)
SELECT trade_date, round(1 - len(list_intersect(names, prev)) / 5.0, 6) AS turnover FROM l WHERE prev IS NOT NULL""")
def turnover_nobuffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(S.turnover(scored(spark, sf_dir), 5), "turnover")


@query(f"""WITH {PM}, {SC}, {SUP}, j AS (SELECT sc.*, CASE WHEN cap > 4000 THEN 'big' ELSE 'small' END AS size FROM sc JOIN sup USING (symbol)),
rk AS (SELECT *, rank() OVER (PARTITION BY trade_date, size ORDER BY s) + (count(*) OVER (PARTITION BY trade_date, size, s) - 1) / 2.0 AS a, rank() OVER (PARTITION BY trade_date, size ORDER BY t) + (count(*) OVER (PARTITION BY trade_date, size, t) - 1) / 2.0 AS b FROM j),
ic AS (SELECT trade_date, size, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS ic FROM rk GROUP BY 1, 2 HAVING count(*) >= 2 AND stddev_pop(a) * stddev_pop(b) > 0)
SELECT size, count(*) AS n, round(avg(ic), 6) AS mean, round(stddev_pop(ic), 6) AS std FROM ic GROUP BY size""")
def bucket_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = suppliers(spark, sf_dir).select("symbol", F.when(F.col("cap") > 4000, "big").otherwise("small").alias("size"))
    return _round(S.bucket_ic(scored(spark, sf_dir).join(sized, "symbol"), "size").select("size", "n", "mean", "std"), "mean", "std")


@query(f"""WITH {_IC}, w AS (SELECT trade_date, count(ic) OVER x AS c, avg(ic) OVER x AS m, stddev_pop(ic) OVER x AS d FROM ic WINDOW x AS (ORDER BY trade_date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT trade_date, round(CASE WHEN c >= 12 THEN m END, 6) AS mean, round(CASE WHEN c >= 12 THEN d END, 6) AS std, round(CASE WHEN c >= 12 THEN m / nullif(d, 0) END, 5) AS ratio FROM w""")
def rolling_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = S.rolling(S.daily_ic(scored(spark, sf_dir)), "ic", 12)
    return made.select("trade_date", F.round("mean", R).alias("mean"), F.round("std", R).alias("std"), F.round("ratio", 5).alias("ratio"))


@query(f"""WITH {_IC}, f AS (SELECT trade_date, symbol, s AS v, t, 'momentum' AS feature FROM sc UNION ALL SELECT trade_date, symbol, vol, t, 'volume' FROM sc),
c AS (SELECT feature, count(v) / count(*) AS coverage FROM f GROUP BY 1),
p AS (SELECT feature, trade_date, covar_pop(v, t) / nullif(stddev_pop(v) * stddev_pop(t), 0) AS ic FROM f GROUP BY 1, 2 HAVING stddev_pop(v) * stddev_pop(t) > 0),
r2 AS (SELECT feature, trade_date, rank() OVER (PARTITION BY feature, trade_date ORDER BY v) + (count(*) OVER (PARTITION BY feature, trade_date, v) - 1) / 2.0 AS a, rank() OVER (PARTITION BY feature, trade_date ORDER BY t) + (count(*) OVER (PARTITION BY feature, trade_date, t) - 1) / 2.0 AS b FROM f),
sp AS (SELECT feature, trade_date, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS ic FROM r2 GROUP BY 1, 2 HAVING stddev_pop(a) * stddev_pop(b) > 0),
q AS (SELECT *, row_number() OVER (PARTITION BY feature, trade_date ORDER BY v, symbol) AS k, count(*) OVER (PARTITION BY feature, trade_date) AS n FROM f), qb AS (SELECT feature, trade_date, greatest(0, ceil((k - 1) * 5.0 / (n - 1)) - 1) AS b, avg(t) AS m FROM q WHERE n >= 5 GROUP BY 1, 2, 3), ls AS (SELECT feature, avg(l) AS ls FROM (SELECT feature, trade_date, max_by(m, b) - min_by(m, b) AS l FROM qb GROUP BY 1, 2) GROUP BY 1)
SELECT feature, round(coverage, 6) AS coverage, round(pe.m, 6) AS ic_pearson, round(pe.p, 6) AS positive_pearson, round(ss.m, 6) AS ic_spearman, round(ss.p, 6) AS positive_spearman, round(ls, 6) AS long_short
FROM c JOIN (SELECT feature, avg(ic) AS m, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END) AS p FROM p GROUP BY 1) pe USING (feature) JOIN (SELECT feature, avg(ic) AS m, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END) AS p FROM sp GROUP BY 1) ss USING (feature) JOIN ls USING (feature)""")
def factor_ic_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = S.factor_report(scored(spark, sf_dir).select("trade_date", "symbol", "t", F.col("s").alias("momentum"), F.col("vol").alias("volume")), ["momentum", "volume"])
    return made.select("feature", *(F.round(c, R).alias(c) for c in ("coverage", "ic_pearson", "positive_pearson", "ic_spearman", "positive_spearman", "long_short")))


@query(f"WITH {PM}, {SC}, d AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM sc)) SELECT trade_date, CASE WHEN idx < CAST(floor(n * 0.8) AS BIGINT) - 2 THEN 'train' WHEN idx >= CAST(floor(n * 0.8) AS BIGINT) THEN 'test' ELSE 'gap' END AS part FROM d")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal = D.calendar(scored(spark, sf_dir))
    split = P.train_test(cal.count(), 0.2, 2)
    return cal.select("trade_date", F.when(F.col("idx") < split.train[1], "train").when(F.col("idx") >= split.test[0], "test").otherwise("gap").alias("part"))


def _fold_rows(spark: SparkSession, cal: DataFrame, folds: list[P.Split]) -> DataFrame:
    table = spark.createDataFrame([(i, *f.train, *f.test) for i, f in enumerate(folds)], "fold int, a int, b int, c int, d int")
    each = F.broadcast(table)  # a row for each fold
    return cal.join(each, ((F.col("idx") >= F.col("a")) & (F.col("idx") < F.col("b"))) | ((F.col("idx") >= F.col("c")) & (F.col("idx") < F.col("d")))).select("fold", "trade_date", (F.col("idx") >= F.col("c")).alias("is_test"))


@query(f"""WITH {PM}, {SC}, d AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM sc)), f AS (SELECT CAST(unnest(range(5)) AS INTEGER) AS fold)
SELECT fold, trade_date, idx >= n - (5 - fold) * (n // 6) AS is_test FROM d, f WHERE idx < n - (5 - fold) * (n // 6) - 1 OR (idx >= n - (5 - fold) * (n // 6) AND idx < n - (5 - fold) * (n // 6) + n // 6)""")
def time_series_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal = D.calendar(scored(spark, sf_dir))
    return _fold_rows(spark, cal, P.time_series(cal.count(), 5, gap=1))


@query(f"""WITH {PM}, {SC}, d AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM sc)), z AS (SELECT *, greatest(1, CAST(floor(n * 0.1) AS BIGINT)) AS size FROM d), f AS (SELECT CAST(unnest(range(3)) AS INTEGER) AS fold), g AS (SELECT *, n - size * (3 - fold) AS lo FROM z, f)
SELECT fold, trade_date, idx >= lo AS is_test FROM g WHERE lo > 1 AND (idx < lo - 1 OR (idx >= lo AND idx < lo + size))""")
def walk_forward_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal = D.calendar(scored(spark, sf_dir))
    return _fold_rows(spark, cal, P.walk_forward(cal.count(), 0.1, 3, gap=1))


@query(None)
def model_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = M.with_features(scored(spark, sf_dir))
    return M.importance(spark, M.fit(df, "gbt", M.FEATURES, "t", trees=5), M.FEATURES)


@query(None)
def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.permutation_ic(M.with_features(scored(spark, sf_dir)), M.FEATURES, "t", runs=2, seed=3)


@query(f"""WITH {PM}, {SC}, v AS (SELECT symbol, count(*) AS n, avg(t) / nullif(stddev_samp(t), 0) AS sharpe FROM sc GROUP BY 1), m AS (SELECT var_samp(sharpe) AS variance, count(*) AS trials FROM v)
SELECT symbol, n, round(sharpe, 5) AS sharpe, round(variance, 6) AS variance, trials FROM v, m""")
def sharpe_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = scored(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), X.safe_div(F.avg("t"), F.stddev_samp("t")).alias("sharpe"))
    m = v.agg(F.var_samp("sharpe").alias("variance"), F.count(F.lit(1)).alias("trials"))
    return v.join(F.broadcast(m)).select("symbol", "n", F.round("sharpe", 5).alias("sharpe"), F.round("variance", R).alias("variance"), "trials")


@query(None)
def deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance that each symbol's Sharpe ratio beats the best of as many independent trials."""
    v = scored(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), X.safe_div(F.avg("t"), F.stddev_samp("t")).alias("sharpe"), X.sample_skew("t").alias("skew"), X.sample_kurtosis("t").alias("kurt"))
    m = v.agg(F.var_samp("sharpe").alias("variance"), F.count(F.lit(1)).alias("trials"))
    made = v.join(F.broadcast(m)).withColumn("best", X.expected_max_sharpe("trials", "variance"))
    return made.select("symbol", F.round("best", R).alias("expected_max"), F.round(X.probabilistic_sharpe("sharpe", "best", "n", "skew", "kurt"), R).alias("dsr"))


@query(f"WITH {PM}, {SC} SELECT symbol, round(skewness(t), 5) AS skew, round(kurtosis(t), 5) AS kurt FROM sc GROUP BY symbol")
def sample_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("symbol").agg(F.round(X.sample_skew("t"), 5).alias("skew"), F.round(X.sample_kurtosis("t"), 5).alias("kurt"))


@query(f"""WITH {_IC}, p AS (SELECT year(trade_date) AS win, 'momentum' AS feature, abs(avg(ic)) AS imp FROM ic GROUP BY 1 UNION ALL SELECT year(trade_date), 'level', avg(ic) + 1 FROM ic GROUP BY 1),
r AS (SELECT *, rank() OVER (PARTITION BY win ORDER BY imp DESC, feature) AS k FROM p)
SELECT feature, count(DISTINCT win) AS windows_seen, round(avg(imp), 6) AS mean_importance, round(stddev_samp(imp), 6) AS std_importance, round(avg(k), 6) AS mean_rank, sum(CASE WHEN k <= 1 THEN 1 ELSE 0 END)::BIGINT AS hits FROM r GROUP BY feature""")
def feature_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    ic = S.daily_ic(scored(spark, sf_dir)).withColumn("win", F.year("trade_date"))
    each = ic.groupBy("win").agg(F.abs(F.avg("ic")).alias("momentum"), (F.avg("ic") + 1).alias("level")).unpivot("win", ["momentum", "level"], "feature", "imp")
    return M.stability(each, "win", "imp", top=1)


@query(f"WITH {PM} SELECT symbol, count(*) AS n FROM pm GROUP BY symbol")
def symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
