"""A ranker boosted on pairs of names of the same date, without forming a pair.

The loss of a pair whose label order is known is exp(lower score - higher score). For a name with score s its sum over the names with
lower labels is exp(-s) times the sum of their exp(score), and over those with higher labels exp(s) times the sum of their exp(-score); both are
running sums along the label, so a round costs a sort of each date, whatever its number of pairs. A round's trees are
regression trees on the gradient over the curvature, weighted by the curvature. Equal labels make no pair; dates with one label have none.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST = 30.0  # scores are kept within this of 0, so that exponentials stay finite


def pair_forces(df: DataFrame, label: str, score: str) -> DataFrame:
    """df with force (the loss's negative gradient by the score), curvature and loss (each pair's, at its higher name)."""
    day, ties = Window.partitionBy("trade_date"), Window.partitionBy("trade_date", label)
    upto = day.orderBy(label).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    up, down = F.exp(F.col(score)), F.exp(-F.col(score))
    below = F.greatest(F.sum(up).over(upto) - F.sum(up).over(ties), F.lit(0.0))
    above = F.greatest(F.sum(down).over(day) - F.sum(down).over(upto), F.lit(0.0))
    made = df.withColumns({"_below": down * below, "_above": up * above})
    return made.withColumns({"force": F.col("_below") - F.col("_above"), "curvature": F.col("_below") + F.col("_above"), "loss": F.col("_below")}).drop("_below", "_above")


@dataclass(frozen=True)
class Ranker:
    trees: tuple[Model, ...]
    features: tuple[str, ...]
    rate: float

    def score(self, df: DataFrame) -> DataFrame:
        """df with pred; rows with a missing feature are left out. Only orders within a date mean anything."""
        made = VectorAssembler(inputCols=list(self.features), outputCol="_x", handleInvalid="skip").transform(df).withColumn("pred", F.lit(0.0))
        for tree in self.trees:
            made = tree.transform(made).withColumn("pred", F.least(F.greatest(F.col("pred") + self.rate * F.col("_step"), F.lit(-MOST)), F.lit(MOST))).drop("_step")
        return made.drop("_x")


def fit_ranker(df: DataFrame, features: Sequence[str], label: str, rounds: int = 10, depth: int = 3, rate: float = 0.5, seed: int = 7) -> Ranker:
    """A job for each round, some tens at most; a round's scores are cached for the next one."""
    keys = ["trade_date", label]
    rows = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip").transform(df.filter(F.col(label).isNotNull() & ~F.isnan(label)))
    rows = rows.select(*keys, "_x", F.lit(0.0).alias("pred")).persist()
    trees: list[Model] = []
    try:
        for _ in range(rounds):
            forced = pair_forces(rows, label, "pred").filter("curvature > 0").withColumn("_t", F.col("force") / F.col("curvature"))
            tree = DecisionTreeRegressor(featuresCol="_x", labelCol="_t", weightCol="curvature", predictionCol="_step", maxDepth=depth, seed=seed).fit(forced)
            trees.append(tree)
            now = F.least(F.greatest(F.col("pred") + rate * F.col("_step"), F.lit(-MOST)), F.lit(MOST))
            after = tree.transform(rows).select(*keys, "_x", now.alias("pred")).persist()
            after.count()
            rows.unpersist()
            rows = after
    finally:
        rows.unpersist()
    return Ranker(tuple(trees), tuple(features), rate)

