"""Linear models over windows, folds, splits and penalties; the oracles solve two features in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dates as D
from ..operators import gram as G
from ..operators import models as M
from ..operators import ranking as R
from ..operators import splits as SP
from .panels import PM, SC, monthly, scored
from .registry import query

FEATURES = M.FEATURES[:2]  # the signal and the volume as z-scores
_Z = f"""{PM}, {SC}, zf AS (SELECT trade_date, symbol, t, coalesce((s - avg(s) OVER d) / nullif(stddev_pop(s) OVER d, 0), 0) AS a, coalesce((vol - avg(vol) OVER d) / nullif(stddev_pop(vol) OVER d, 0), 0) AS b FROM sc WINDOW d AS (PARTITION BY trade_date)),
dd AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM zf))"""


def _sums(key: str) -> str:
    """Centred sums ce of the rows tr (key, a, b, t)."""
    return f"""mo AS (SELECT {key} AS key, count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(t) AS sy, sum(a * a) AS saa, sum(a * b) AS sab, sum(b * b) AS sbb, sum(a * t) AS say, sum(b * t) AS sby FROM tr GROUP BY 1),
ce AS (SELECT key, n, saa - sa * sa / n AS p, sab - sa * sb / n AS q, sbb - sb * sb / n AS r, say - sa * sy / n AS u, sby - sb * sy / n AS v, sa / n AS ma, sb / n AS mb, sy / n AS my FROM mo)"""


def _ridge(key: str, alpha: float = 1.0) -> str:
    """Coefficients co of the rows tr, by Cramer's rule."""
    det = f"((p + {alpha}) * (r + {alpha}) - q * q)"
    return f"""{_sums(key)}, cc AS (SELECT key, ma, mb, my, (u * (r + {alpha}) - v * q) / {det} AS ba, (v * (p + {alpha}) - u * q) / {det} AS bb FROM ce), co AS (SELECT key, ba, bb, my - ba * ma - bb * mb AS b0 FROM cc)"""


_PRED = "round(b0 + ba * a + bb * b, 10)"


def _ic(source: str, score: str, *keys: str) -> str:
    """A query of key and the mean daily IC of a source."""
    by = ", ".join(keys)
    rank = lambda c: f"rank() OVER (PARTITION BY {by}, trade_date ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, trade_date, {c}) - 1) / 2.0"
    return f"""SELECT {by}, avg(ic) AS ic FROM (SELECT {by}, trade_date, CASE WHEN stddev_pop(x) * stddev_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS ic FROM (SELECT {by}, trade_date, {rank(score)} AS x, {rank("t")} AS y FROM {source}) GROUP BY {by}, trade_date) GROUP BY {by}"""


def _report(key: str, k: int = 5, q: int = 5) -> str:
    """Daily figures dy of the rows te (key, trade_date, symbol, t, pred, signal)."""
    day = f"PARTITION BY {key}, trade_date"
    rank = lambda c: f"rank() OVER ({day} ORDER BY {c}) + (count(*) OVER ({day}, {c}) - 1) / 2.0"
    cor = lambda x, y: f"CASE WHEN stddev_pop({x}) * stddev_pop({y}) > 0 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"
    return f"""rk AS (SELECT *, {rank("signal")} AS x, {rank("t")} AS y, CASE WHEN count(*) OVER ({day}) >= {q} THEN greatest(0, ceil((row_number() OVER ({day} ORDER BY signal, symbol) - 1) * {q}.0 / (count(*) OVER ({day}) - 1)) - 1) END AS bucket, row_number() OVER ({day} ORDER BY signal DESC, symbol) AS k FROM te),
dy AS (SELECT {key}, trade_date, {cor("x", "y")} AS ic, {cor("signal", "t")} AS pearson, count(CASE WHEN sign(pred) = sign(t) THEN 1 END) AS hits, sum(abs(pred - t)) AS gap, count(*) AS n, avg(CASE WHEN bucket = 0 THEN t END) AS lo, avg(CASE WHEN bucket = {q - 1} THEN t END) AS hi, avg(CASE WHEN k <= {k} THEN t END) AS top_mean, avg(CASE WHEN k <= {k} THEN CASE WHEN t > 0 THEN 1.0 ELSE 0 END END) AS top_positive, list(symbol) FILTER (k <= {k}) AS names FROM rk GROUP BY ALL)"""


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n, kind in df.dtypes if kind == "double"})


def _panel(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    df = M.with_features(scored(spark, sf_dir))
    cal = D.calendar(df)
    return df, cal, cal.count()


@query(f"WITH {_Z}, tr AS (SELECT 1 AS g, a, b, t FROM zf), {_ridge('g')} SELECT trade_date, symbol, round({_PRED}, 6) AS pred FROM zf, co")
def ridge_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, cal, n = _panel(spark, sf_dir)
    rows = G.window_scores(df, cal, [SP.Split((0, n), (0, n))], FEATURES, "t").filter("role = 'test'")
    return _rounded(rows.select("trade_date", "symbol", "pred"))


_WF = f"""{_Z}, wl AS (SELECT *, n - greatest(1, CAST(floor(n * 0.15) AS BIGINT)) * (2 - w) AS lo, greatest(1, CAST(floor(n * 0.15) AS BIGINT)) AS size FROM dd, range(2) AS x(w)), wd AS (SELECT CAST(w AS INTEGER) AS win, trade_date, CASE WHEN idx < lo - 1 THEN 'train' ELSE 'test' END AS role FROM wl WHERE idx < lo - 1 OR (idx >= lo AND idx < lo + size)),
tr AS (SELECT win, a, b, t FROM zf JOIN wd USING (trade_date) WHERE role = 'train'), {_ridge('win')}, pr AS (SELECT win, role, trade_date, symbol, t, {_PRED} AS pred FROM zf JOIN wd USING (trade_date) JOIN co ON co.key = win),
dx AS (SELECT win, ic AS train_ic, CASE WHEN ic < 0 THEN -1.0 ELSE 1.0 END AS direction FROM ({_ic("(SELECT * FROM pr WHERE role = 'train')", "pred", "win")})), te AS (SELECT win, trade_date, symbol, t, pred, pred * direction AS signal FROM pr JOIN dx USING (win) WHERE role = 'test'), {_report("win")},
tn AS (SELECT *, CASE WHEN lag(names) OVER w IS NOT NULL THEN 1 - len(list_intersect(names, lag(names) OVER w)) / CAST(len(names) AS DOUBLE) END AS turnover FROM dy WINDOW w AS (PARTITION BY win ORDER BY trade_date)), nt AS (SELECT *, top_mean - CASE WHEN turnover IS NULL THEN 1.0 ELSE 2 * turnover END * 10 / 1e4 AS net FROM tn)"""


@query(f"""WITH {_WF} SELECT win AS "window", 'ok' AS status, direction, round(avg(ic), 6) AS test_ic, round(sum(gap) / sum(n), 6) AS mae, round(sum(hits) / sum(n), 6) AS hit_rate FROM nt JOIN dx USING (win) GROUP BY 1, 3""")
def walk_forward_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, cal, n = _panel(spark, sf_dir)
    made = G.walk_forward(df, cal, SP.walk_forward(n, 0.15, 2, gap=1), FEATURES, "t")
    return _rounded(made.select("window", "status", "direction", "test_ic", "mae", "hit_rate"))


@query(f"""WITH {_WF} SELECT win AS "window", 'ok' AS status, min(trade_date) AS test_start, max(trade_date) AS test_end, direction, round(train_ic, 6) AS train_ic, count(ic) AS ic_n, round(avg(ic), 6) AS test_ic, round(stddev_pop(ic), 6) AS ic_std, round(avg(ic) / nullif(stddev_pop(ic), 0), 6) AS ic_ir, round(avg(pearson), 6) AS pearson_ic,
round(avg(hi) - avg(lo), 6) AS long_short, round(sum(hits) / sum(n), 6) AS hit_rate, round(sum(gap) / sum(n), 6) AS mae, round(avg(turnover), 6) AS turnover, round(avg(top_positive), 6) AS topk_positive, count(net) AS periods, round(avg(top_mean), 6) AS mean_gross, round(avg(net), 6) AS mean_net, round(product(1 + net) - 1, 6) AS total_net FROM nt JOIN dx USING (win) GROUP BY win, direction, train_ic""")
def walk_forward_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, cal, n = _panel(spark, sf_dir)
    return _rounded(G.walk_forward(df, cal, SP.walk_forward(n, 0.15, 2, gap=1), FEATURES, "t", bps=10.0))


@query(f"""WITH {_Z}, fo AS (SELECT *, n - (n // 4) * (3 - f) AS lo, n // 4 AS size FROM dd, range(3) AS x(f)), wd AS (SELECT CAST(f AS INTEGER) AS fold, trade_date, idx >= lo AS test FROM fo WHERE idx < lo - 1 OR (idx >= lo AND idx < lo + size)),
tr AS (SELECT fold, a, b, t FROM zf JOIN wd USING (trade_date) WHERE NOT test), {_ridge('fold')}, pr AS (SELECT fold, trade_date, symbol, t, {_PRED} AS pred FROM zf JOIN wd USING (trade_date) JOIN co ON co.key = fold WHERE test), ev AS ({_ic("pr", "pred", "fold")})
SELECT fold, round(ic, 6) AS ic, CASE WHEN avg(ic) OVER () < 0 THEN -1.0 ELSE 1.0 END AS direction FROM ev""")
def cv_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, cal, n = _panel(spark, sf_dir)
    return _rounded(G.folds(df, cal, SP.time_series(n, 3, gap=1), FEATURES, "t"))


_SOFT = "sign({0}) * greatest(abs({0}) - lam * l1, 0) / ({1} + lam * (1 - l1))"
_X = _SOFT.format("(u / n - q / n * y)", "p / n")
_Y = _SOFT.format(f"(v / n - q / n * ({_X}))", "r / n")


@query(f"""WITH RECURSIVE {_Z}, ho AS (SELECT *, CAST(floor(n * 0.8) AS BIGINT) AS cut FROM dd), tr AS (SELECT 1 AS g, a, b, t FROM zf JOIN ho USING (trade_date) WHERE idx < cut), {_sums('g')},
st AS (SELECT kind, lam, l1, ce.* FROM ce, (VALUES ('ridge', 0.1::DOUBLE, 0.0::DOUBLE), ('ridge', 10.0, 0.0), ('elasticnet', 0.001, 0.5), ('elasticnet', 0.01, 0.5), ('elasticnet', 0.001, 0.9), ('elasticnet', 0.01, 0.9)) AS x(kind, lam, l1)),
rg AS (SELECT kind, lam, l1, (u * (r + lam) - v * q) / ((p + lam) * (r + lam) - q * q) AS ba, (v * (p + lam) - u * q) / ((p + lam) * (r + lam) - q * q) AS bb, ma, mb, my FROM st WHERE kind = 'ridge'),
cd AS (SELECT lam, l1, n, p, q, r, u, v, ma, mb, my, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0 AS k FROM st WHERE kind = 'elasticnet' UNION ALL SELECT lam, l1, n, p, q, r, u, v, ma, mb, my, {_X}, {_Y}, k + 1 FROM cd WHERE k < 100),
co AS (SELECT kind, lam, l1, ba, bb, my - ba * ma - bb * mb AS b0 FROM rg UNION ALL SELECT 'elasticnet', lam, l1, x, y, my - x * ma - y * mb FROM cd WHERE k = 100),
pr AS (SELECT kind, lam, l1, trade_date, symbol, t, {_PRED} AS pred FROM zf JOIN ho USING (trade_date), co WHERE idx >= cut), ev AS ({_ic("pr", "pred", "kind", "lam", "l1")})
SELECT kind, lam AS alpha, l1 AS l1_ratio, round(ic, 6) AS ic FROM ev""")
def linear_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge and elastic net over a grid of penalties, judged on the last fifth of the dates."""
    df, cal, n = _panel(spark, sf_dir)
    cut = int(n * 0.8)
    split = SP.Split((0, cut), (cut, n))
    ridge = G.sweep(df, cal, split, FEATURES, "t", [0.1, 10.0])
    both = ridge.unionByName(G.sweep(df, cal, split, FEATURES, "t", [0.001, 0.01], [0.5, 0.9]).filter("kind = 'elasticnet'"))
    return _rounded(both)


@query(f"WITH {_Z}, tr AS (SELECT 1 AS g, a, b, t FROM zf JOIN dd USING (trade_date) WHERE idx < n - 1), {_ridge('g')}, pr AS (SELECT trade_date, symbol, {_PRED} AS pred FROM zf JOIN dd USING (trade_date), co WHERE idx = n - 1) SELECT trade_date, symbol, round(pred, 6) AS pred, CAST(row_number() OVER (ORDER BY pred DESC, symbol) AS INTEGER) AS place FROM pr")
def live_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(G.latest(M.with_features(scored(spark, sf_dir)), FEATURES, "t"))


@query(f"""WITH {_Z}, tr AS (SELECT 1 AS g, a, b, t FROM zf), {_ridge('g')}, pr AS (SELECT trade_date, symbol, b, {_PRED} AS pred FROM zf, co),
nu AS (SELECT trade_date, symbol, pred, CASE WHEN count(*) OVER d >= 3 THEN pred - avg(pred) OVER d - coalesce(covar_pop(pred, b) OVER d / nullif(var_pop(b) OVER d, 0), 0) * (b - avg(b) OVER d) ELSE pred END AS z FROM pr WINDOW d AS (PARTITION BY trade_date))
SELECT trade_date, symbol, round(z, 6) AS pred, round(CASE WHEN pred <> 0 THEN -z ELSE z END, 6) AS signal FROM nu""")
def neutral_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, cal, n = _panel(spark, sf_dir)
    rows = G.window_scores(df, cal, [SP.Split((0, n), (0, n))], FEATURES, "t").filter("role = 'test'").withColumn("signal", -F.col("pred"))
    return _rounded(M.neutral_predictions(rows, ["f_vol"]).select("trade_date", "symbol", "pred", "signal"))


@query(None)
def pairwise_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a ranker boosted on all pairs of a date; trees are no SQL (tests compare its gradient with all pairs)."""
    df = M.with_features(scored(spark, sf_dir))
    made = R.fit_ranker(df, M.FEATURES, "t", rounds=4).score(df)
    return _rounded(made.select("trade_date", "symbol", "pred"))


# ---- combinatorial splits, refitted


def _roles(horizon: int) -> str:
    """Roles ro (split, grp, trade_date, role, mode) of the 28 splits of 8 groups, with label windows of so many dates, 40 days' embargo and a gap of 2."""
    return f"""{_Z}, gr AS (SELECT trade_date, CAST(ntile(8) OVER (ORDER BY trade_date) - 1 AS INTEGER) AS grp, row_number() OVER (ORDER BY trade_date) AS pos FROM dd), pc AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i FROM (SELECT DISTINCT trade_date FROM pm)),
lw AS (SELECT gr.trade_date, grp, pos, x.trade_date AS start, y.trade_date AS stop FROM gr JOIN pc x ON x.trade_date = gr.trade_date LEFT JOIN pc y ON y.i = x.i + {horizon}), sl AS (SELECT a, b, CAST(row_number() OVER (ORDER BY a, b) - 1 AS INTEGER) AS split FROM range(8) x(a), range(8) y(b) WHERE a < b),
te0 AS (SELECT split, lw.* FROM sl JOIN lw ON grp = a OR grp = b), hu AS (SELECT split, min(pos) AS lo, max(pos) AS hi, count(*) = count(stop) AS whole FROM te0 GROUP BY 1),
ro AS (SELECT sl.split, lw.grp, lw.trade_date, CASE WHEN whole THEN 'event_window' ELSE 'fallback_gap' END AS mode, CASE WHEN lw.grp = a OR lw.grp = b THEN 'test'
  WHEN NOT whole THEN CASE WHEN pos BETWEEN lo - 2 AND hi + 2 THEN 'purged' ELSE 'train' END
  WHEN lw.stop IS NULL OR EXISTS (SELECT 1 FROM te0 z WHERE z.split = sl.split AND z.start <= lw.stop AND lw.start <= z.stop) THEN 'purged'
  WHEN EXISTS (SELECT 1 FROM te0 z WHERE z.split = sl.split AND z.stop < lw.trade_date AND lw.trade_date <= z.stop + INTERVAL 40 DAY) THEN 'embargoed' ELSE 'train' END AS role FROM sl JOIN hu USING (split), lw)"""


def _role_rows(spark: SparkSession, sf_dir: str, df: DataFrame, horizon: int) -> DataFrame:
    windows = D.label_windows(df, D.calendar(monthly(spark, sf_dir)), horizon, 0)
    return G.cpcv_roles(D.groups(df, 8), 8, 2, windows, embargo_days=40, gap_steps=2)


@query(f"WITH {_roles(3)} SELECT split, grp, trade_date, role, mode AS purge_mode FROM ro")
def cpcv_purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _role_rows(spark, sf_dir, scored(spark, sf_dir), 3)


_REFIT = f"""{_roles(1)}, tr AS (SELECT split, a, b, t FROM zf JOIN ro USING (trade_date) WHERE role = 'train'), {_ridge('split')}, pr AS (SELECT split, grp, role, trade_date, symbol, t, {_PRED} AS pred FROM zf JOIN ro USING (trade_date) JOIN co ON co.key = split WHERE role IN ('train', 'test')),
dx AS (SELECT split, CASE WHEN ic < 0 THEN -1.0 ELSE 1.0 END AS direction FROM ({_ic("(SELECT * FROM pr WHERE role = 'train')", "pred", "split")})), te AS (SELECT split, grp, trade_date, symbol, t, pred, pred * direction AS signal FROM pr JOIN dx USING (split) WHERE role = 'test'), {_report("split, grp")},
pt AS (SELECT CAST(g AS INTEGER) AS grp, split, CAST(row_number() OVER (PARTITION BY g ORDER BY split) - 1 AS INTEGER) AS path FROM range(8) z(g) JOIN sl ON g = a OR g = b), ps AS (SELECT path, trade_date, split, ic, top_mean AS ret FROM dy JOIN pt USING (split, grp))"""


def _path_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = M.with_features(scored(spark, sf_dir))
    days = G.cpcv_days(df, _role_rows(spark, sf_dir, df, 1), FEATURES, "t")
    paths = spark.createDataFrame([(p, g, s) for p, path in enumerate(SP.paths(8, 2)) for g, s in path], "path int, grp int, split int")
    return G.cpcv_paths(days, paths)


@query(f"WITH {_REFIT} SELECT path, trade_date, split, round(ic, 6) AS ic, round(ret, 6) AS ret FROM ps")
def cpcv_path_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_path_series(spark, sf_dir))


@query(f"""WITH {_REFIT}, nv AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY path ORDER BY trade_date)) AS nav FROM ps), fl AS (SELECT *, nav / greatest(max(nav) OVER (PARTITION BY path ORDER BY trade_date), 1) - 1 AS fall FROM nv)
SELECT path, count(ret) AS periods, round(avg(ic), 6) AS ic, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS std, round((product(1 + ret) - 1) / product(1 + ret), 6) AS total_share, round(min(fall), 6) AS max_drawdown, round(avg(ret) / stddev_samp(ret) * sqrt(12), 6) AS sharpe FROM fl GROUP BY path""")
def cpcv_refit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """total_share: the share of a path's final value that was gained."""
    made = G.path_figures(_path_series(spark, sf_dir))
    return _rounded(made.withColumn("total_share", F.col("total_return") / (1 + F.col("total_return"))).drop("total_return"))
