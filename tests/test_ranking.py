"""The pairwise ranker: its sums against all pairs, and its orders against the pointwise stand-in."""

import math
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from xpanel.operators import models as M
from xpanel.operators import ranking as R


def panel(spark, days, names=14, seed=3):
    r = np.random.default_rng(seed)
    rows = []
    for d in days:
        shift = float(r.normal() * 2)
        for i in range(names):
            a, b = r.normal(size=2)
            y = float(np.round(a + 0.8 * (b > 0.5) + r.normal() * 0.3 + 5 * shift, 1))
            rows.append((date(2020, 1, 1) + timedelta(days=d), f"s{i}", float(a), float(b), y))
    return spark.createDataFrame(rows, "trade_date date, symbol string, a double, b double, t double"), rows


def accuracy(rows, scores):
    right = pairs = 0
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[4], scores[r[0], r[1]]))
    for day in by.values():
        for y, s in day:
            for z, u in day:
                if y > z:
                    pairs, right = pairs + 1, right + (s > u) + 0.5 * (s == u)
    return right / pairs


def test_forces_equal_all_pairs(spark):
    df, rows = panel(spark, range(3))
    made = R.pair_forces(df.withColumn("s", F.col("b") * 0.7), "t", "s").collect()
    for r in made:
        lower = [math.exp(x.s - r.s) for x in made if x.trade_date == r.trade_date and x.t < r.t]
        higher = [math.exp(r.s - x.s) for x in made if x.trade_date == r.trade_date and x.t > r.t]
        assert math.isclose(r.force, sum(lower) - sum(higher), abs_tol=1e-9) and math.isclose(r.curvature, sum(lower) + sum(higher), abs_tol=1e-9) and math.isclose(r.loss, sum(lower), abs_tol=1e-9)


def test_ranker_orders_better_than_ranks_as_labels(spark):
    train, _ = panel(spark, range(25))
    test, rows = panel(spark, range(100, 110), seed=8)
    ranker = R.fit_ranker(train, ["a", "b"], "t", rounds=8, depth=3)
    mine = {(r.trade_date, r.symbol): r.pred for r in ranker.score(test).collect()}
    stand_in = M.predict(M.fit(train, "ranker", ["a", "b"], "t", trees=8), test, ["a", "b"])
    theirs = {(r.trade_date, r.symbol): r.pred for r in stand_in.collect()}
    assert accuracy(rows, mine) > max(0.8, accuracy(rows, theirs))
    loss = [R.pair_forces(R.Ranker(ranker.trees[:k], ranker.features, ranker.rate).score(train), "t", "pred").agg(F.sum("loss")).first()[0] for k in (0, 2, 8)]
    assert loss[0] > loss[1] > loss[2]


def test_dates_without_pairs(spark):
    df = spark.createDataFrame([(date(2020, 1, 1), "x", 1.0, 2.0, 5.0), (date(2020, 1, 2), "x", 1.0, None, 5.0)], "trade_date date, symbol string, a double, b double, t double")
    [r] = R.pair_forces(df.limit(1), "t", "a").collect()
    assert r.force == r.curvature == 0.0
