"""Models behind one registry of pyspark.ml estimators. Training is distributed; only fold and run tables are driver-sized."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import average_rank
from . import crosssection as CS
from . import signals as S
from .splits import Split, rows_of

FEATURES = ["f_signal", "f_vol", "f_amount"]


def with_features(df: DataFrame) -> DataFrame:
    """Cross-sectional z-scores of the signal, volume and amount."""
    return df.withColumns({n: CS.zscore(c) for n, c in zip(FEATURES, ("s", "vol", "amount"), strict=True)})


def _ridge(df: DataFrame, label: str, alpha: float = 1.0, **_: object) -> LinearRegression:
    """Sum-of-squares ridge with penalty alpha, in the estimator's scaling."""
    n, dev = df.agg(F.count(label), F.stddev_pop(label)).first()
    return LinearRegression(regParam=alpha * (dev or 0.0) / max(n, 1), elasticNetParam=0.0, standardization=False, solver="normal")


def _elastic(df: DataFrame, label: str, alpha: float = 0.01, l1_ratio: float = 0.5, **_: object) -> LinearRegression:
    return LinearRegression(regParam=alpha, elasticNetParam=l1_ratio, standardization=False)


def _gbt(df: DataFrame, label: str, trees: int = 20, depth: int = 3, rate: float = 0.05, seed: int = 7, **_: object) -> GBTRegressor:
    return GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, seed=seed)


REGISTRY: dict[str, Callable] = {"ridge": _ridge, "elasticnet": _elastic, "gbt": _gbt, "ranker": _gbt}


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip").transform(df)


def fit(df: DataFrame, kind: str, features: Sequence[str], label: str, weight: str | None = None, **settings: object) -> Model:
    """kind: ridge, elasticnet, gbt, or ranker (boosted trees on the label's rank within its date)."""
    if kind not in REGISTRY:
        raise ValueError(f"unknown model {kind!r}; known: {', '.join(REGISTRY)}")
    df = df.filter(F.col(label).isNotNull())
    if kind == "ranker":
        df = df.withColumn(label, average_rank(label, "trade_date") / F.count(label).over(CS.by_date()))
    made = REGISTRY[kind](df, label, **settings)
    made.setFeaturesCol("_x").setLabelCol(label).setPredictionCol("pred")
    if weight:
        made.setWeightCol(weight)
    return made.fit(_vectors(df, features))


def predict(model: Model, df: DataFrame, features: Sequence[str], direction: float = 1.0) -> DataFrame:
    """df with pred and signal, its signed copy."""
    return model.transform(_vectors(df, features)).drop("_x").withColumn("signal", F.col("pred") * direction)


def importance(spark: SparkSession, model: Model, features: Sequence[str]) -> DataFrame:
    values = model.featureImportances.toArray() if hasattr(model, "featureImportances") else abs(model.coefficients.toArray())
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values, strict=True)], "feature string, importance double")


def stability(importances: DataFrame, window: str, value: str, top: int) -> DataFrame:
    """Across windows: how often seen, mean and deviation, mean rank, and how often among the top."""
    ranked = importances.withColumn("k", F.rank().over(Window.partitionBy(window).orderBy(F.desc(value), "feature")))
    return ranked.groupBy("feature").agg(F.countDistinct(window).alias("windows_seen"), F.round(F.avg(value), 6).alias("mean_importance"), F.round(F.stddev_samp(value), 6).alias("std_importance"), F.round(F.avg("k"), 6).alias("mean_rank"), F.sum((F.col("k") <= top).cast("long")).alias("hits"))


def direction(df: DataFrame, mode: str = "fixed", fixed: float = 1.0, flip_below: float = 0.0) -> float:
    """+1 or -1: as given, or by the sign of the mean IC of pred on these rows."""
    if mode == "fixed":
        return fixed
    mean = S.daily_ic(df, "pred").agg(F.avg("ic")).first()[0]
    return -fixed if mean is not None and mean < flip_below else fixed


def permutation_ic(df: DataFrame, features: Sequence[str], label: str, runs: int, seed: int, kind: str = "ridge") -> DataFrame:
    """run, mean_ic after refitting on labels dealt anew within each date. One small row for each run, some tens at most; the rows are cached for them."""
    df, out = df.persist(), []
    for run in range(runs):
        dealt = CS.permute(df, label, seed + run, "_label")
        scored = predict(fit(dealt, kind, features, "_label"), df, features)
        out.append((run, S.daily_ic(scored, "pred", label).agg(F.avg("ic")).first()[0]))
    df.unpersist()
    return df.sparkSession.createDataFrame(out, "run int, mean_ic double")


def evaluate_windows(df: DataFrame, cal: DataFrame, windows: list[Split], features: Sequence[str], label: str, kind: str = "ridge", mode: str = "train_ic") -> DataFrame:
    """One row for each window: fit on its training dates, direction from there, IC and errors on its test dates.

    A fit and a few actions for each window, in turn, so some tens of windows at most; the rows are cached for them.
    """
    df, out = df.persist(), []
    for i, w in enumerate(windows):
        train, test = rows_of(df, cal, *w.train), rows_of(df, cal, *w.test)
        if not train.head(1) or not test.head(1):
            out.append((i, "insufficient_data", None, None, None, None))
            continue
        model = fit(train, kind, features, label)
        sign = direction(predict(model, train, features), mode)
        scored = predict(model, test, features, sign)
        mean = S.daily_ic(scored, "signal", label).agg(F.avg("ic")).first()[0]
        e = S.errors(scored, "pred", label).first()
        out.append((i, "ok", sign, mean, e["mae"], e["hit_rate"]))
    df.unpersist()
    return df.sparkSession.createDataFrame(out, "window int, status string, direction double, test_ic double, mae double, hit_rate double")


def neutral_predictions(scored: DataFrame, controls: Sequence[str], strength: float = 1.0, least: int = 3) -> DataFrame:
    """scored with pred less its regression on the controls within each date, and signal likewise."""
    made = CS.neutralize(scored, "pred", controls, strength, least, "_neutral")
    sign = F.signum(F.col("signal") * F.col("pred"))
    return made.withColumns({"signal": F.when(F.col("pred") != 0, sign * F.col("_neutral")).otherwise(F.col("_neutral")), "pred": F.col("_neutral")}).drop("_neutral")
