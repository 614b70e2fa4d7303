"""Models from sums: closed forms, optimality, and purging against brute force."""

import re
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from xpanel.operators import dates as D
from xpanel.operators import gram as G
from xpanel.operators import models as M
from xpanel.operators import splits as SP

NAMES = ["a", "b", "c"]


def panel(spark, days=30, names=12, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for d in range(days):
        x = r.normal(size=(names, 3))
        x[:, 2] += 0.8 * x[:, 0]
        y = x @ [0.5, -0.2, 0.1] + 0.3 + r.normal(size=names) * 0.4
        rows += [(date(2020, 1, 1) + timedelta(days=d), f"s{i}", *map(float, x[i]), float(y[i])) for i in range(names)]
    rows[3] = (*rows[3][:2], None, *rows[3][3:])
    rows[5] = (*rows[5][:5], None)
    return spark.createDataFrame(rows, "trade_date date, symbol string, a double, b double, c double, t double"), rows


def arrays(rows, lo, hi):
    some = [r for r in rows if None not in r and lo <= (r[0] - date(2020, 1, 1)).days < hi]
    return np.array([r[2:5] for r in some]), np.array([r[5] for r in some])


def test_ridges_of_all_windows_equal_direct_solutions(spark):
    df, rows = panel(spark)
    windows = [SP.Split((0, 10), (11, 15)), SP.Split((5, 25), (26, 30)), SP.Split((3, 3), (4, 5))]
    got = G.window_scores(df, D.calendar(df), windows, NAMES, "t", (0.0, 2.0)).collect()
    for w in (0, 1):
        x, y = arrays(rows, *windows[w].train)
        for alpha in (0.0, 2.0):
            c = x - x.mean(0)
            beta = np.linalg.solve(c.T @ c + alpha * np.eye(3), c.T @ (y - y.mean()))
            mine = [r for r in got if r.window == w and r.alpha == alpha]
            assert {r.role for r in mine} == {"train", "test"}
            assert all(abs(r.pred - (y.mean() + (np.array([r.a, r.b, r.c]) - x.mean(0)) @ beta)) < 1e-8 for r in mine)
    assert not [r for r in got if r.window == 2 and r.pred is not None]
    report = {r.window: r for r in G.walk_forward(df, D.calendar(df), windows, NAMES, "t").collect()}
    assert report[2].status == "insufficient_data" and report[0].status == "ok" and report[0].direction == 1.0 and report[0].test_ic > 0.5
    old = {r.window: r for r in M.evaluate_windows(df, D.calendar(df), windows[:2], NAMES, "t").collect()}
    assert all(abs(old[w].test_ic - report[w].test_ic) < 0.02 for w in (0, 1))


def test_left_out_dates_and_weights(spark):
    df, rows = panel(spark)
    keys = spark.createDataFrame([(0,), (1,)], "split int")
    out = spark.createDataFrame([(1, date(2020, 1, 1) + timedelta(days=d)) for d in range(12)], "split int, trade_date date")
    [m] = [r for r in G.solved(G.left_over(G.daily_sums(df, NAMES, "t"), out, keys, NAMES), NAMES, (1.0,)).collect() if r.split == 1]
    x, y = arrays(rows, 12, 30)
    c = x - x.mean(0)
    assert np.allclose(m.beta, np.linalg.solve(c.T @ c + np.eye(3), c.T @ (y - y.mean()))) and m.rows == len(y)
    doubled = G.daily_sums(df.withColumn("w", F.lit(2.0)), NAMES, "t", "w").agg(F.sum(F.col("m")[0])).first()[0]
    assert doubled == 2 * G.daily_sums(df, NAMES, "t").agg(F.sum(F.col("m")[0])).first()[0]


def test_collinear_features_have_no_single_solution(spark):
    df, _ = panel(spark)
    same = df.withColumn("b", 2 * F.col("a"))
    [free, held] = G.solved(G.daily_sums(same, ["a", "b"], "t").agg(G._each("m", 10, F.sum).alias("m")), ["a", "b"], (0.0, 1.0)).orderBy("alpha").collect()
    assert free.intercept is None and held.intercept is not None


def test_elastic_net_meets_its_conditions(spark):
    df, rows = panel(spark)
    sums = G.daily_sums(df, NAMES, "t").agg(G._each("m", 15, F.sum).alias("m"))
    x, y = arrays(rows, 0, 30)
    c, e = x - x.mean(0), y - y.mean()
    for r in G.elastic(sums, NAMES, [(0.01, 0.5), (0.2, 0.9), (5.0, 1.0)]).collect():
        b = np.array(r.beta)
        slope = c.T @ (e - c @ b) / len(y) - r.alpha * (1 - r.l1_ratio) * b
        lam = r.alpha * r.l1_ratio
        assert all(abs(s - lam * np.sign(v)) < 1e-8 if v else abs(s) <= lam + 1e-8 for s, v in zip(slope, b, strict=True))
        assert r.alpha < 5 or not b.any()


def test_latest_scores_the_last_date(spark):
    df, _ = panel(spark)
    assert G.latest(df, NAMES, "t").count() == 12 and G.latest(df.limit(0), NAMES, "t").count() == 0


def brute_roles(days, grp, windows, split, embargo, gap):
    test = [d for d in days if grp[d] in split]
    out = {}
    whole = all(d in windows for d in test)
    at = [days.index(d) for d in test]
    for i, d in enumerate(days):
        if d in test:
            out[d] = "test"
        elif not whole:
            out[d] = "purged" if gap > 0 and min(at) - gap <= i <= max(at) + gap else "train"
        elif d not in windows or any(windows[d][0] <= windows[x][1] and windows[x][0] <= windows[d][1] for x in test):
            out[d] = "purged"
        else:
            out[d] = "embargoed" if any(windows[x][1] < d <= windows[x][1] + timedelta(days=embargo) for x in test) else "train"
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_purging_equals_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    days = [date(2020, 1, 1) + timedelta(days=int(x)) for x in np.sort(r.choice(120, 24, replace=False))]
    grp = {d: i // 4 for i, d in enumerate(days)}
    spans = {d: (d + timedelta(days=int(r.integers(0, 4))), d + timedelta(days=int(r.integers(4, 20)))) for d in days}
    for d in (days[13], days[14]) if seed == 2 else ():
        spans.pop(d)
    dates = spark.createDataFrame(list(grp.items()), "trade_date date, grp int")
    windows = spark.createDataFrame([(d, *s) for d, s in spans.items()], "trade_date date, start date, stop date")
    from itertools import combinations

    for embargo, gap in ((0, 0), (9, 2)):
        got = G.cpcv_roles(dates, 6, 2, windows, embargo, gap).collect()
        for i, c in enumerate(combinations(range(6), 2)):
            assert {x.trade_date: x.role for x in got if x.split == i} == brute_roles(days, grp, spans, c, embargo, gap)
    none = {x.trade_date: x.role for x in G.cpcv_roles(dates, 6, 2, None, 0, 2).filter("split = 0").collect()}
    assert none == brute_roles(days, grp, {}, (0, 1), 0, 2)


def test_rows_of_many_splits_are_ranked_in_bounded_tasks(spark, capsys, monkeypatch):
    """Dealt in small tasks, each date's splits in several parts, the figures stay the same."""
    days = spark.range(16).select(F.expr("date_add(date'2020-01-01', cast(id as int))").alias("trade_date"))
    panel = days.crossJoin(spark.range(12).select(F.col("id").cast("string").alias("symbol")))
    draw = lambda i: F.round(F.pmod(F.hash("trade_date", "symbol", F.lit(i)), F.lit(1000)) / 1000, 3)
    df = panel.select("trade_date", "symbol", *(draw(i).alias(c) for i, c in enumerate(("a", "b", "t"))))
    roles = G.cpcv_roles(D.groups(df, 4), 4, 2, gap_steps=1)

    def figures():
        made = G.cpcv_days(df, roles, ["a", "b"], "t", k=3)
        made.explain()
        return sorted((x.split, x.grp, x.trade_date, round(x.ic, 9), round(x.top_mean, 9), x.hits, tuple(x.names)) for x in made.collect()), capsys.readouterr().out

    whole, _ = figures()
    monkeypatch.setattr(G, "RANKED", 20)  # of some 50 or 60 rows of a date in all splits
    small, plan = figures()
    assert small == whole and len(whole) == 5 * 8  # the split of the first and last group has no dates to train on
    assert any(int(n) >= 50 for n in re.findall(r"_part#\d+, (\d+)\), REPARTITION_BY_NUM", plan))  # tasks by the number of rows


def test_rows_are_copied_for_the_parts_of_splits_in_bounded_tasks(spark, capsys, monkeypatch):
    """Rows of several parts are dealt by date and symbol before they are copied; one part needs no such deal."""
    days = spark.range(16).select(F.expr("date_add(date'2020-01-01', cast(id as int))").alias("trade_date"))
    panel = days.crossJoin(spark.range(12).select(F.col("id").cast("string").alias("symbol")))
    df = panel.select("trade_date", "symbol", *(F.pmod(F.hash("trade_date", "symbol", F.lit(i)), F.lit(97)).cast("double").alias(c) for i, c in enumerate(("a", "b", "t"))))
    roles = G.cpcv_roles(D.groups(df, 4), 4, 2, gap_steps=1)
    copying = r"Generate explode\(.*\n(?:.*(?:Project|Filter|WholeStage|AQEShuffle|InputAdapter|ShuffleQuery).*\n)*.*Exchange hashpartitioning\(trade_date#\d+, symbol#\d+, (\d+)\), REPARTITION_BY_NUM"

    def made():
        days = G.cpcv_days(df, roles, ["a", "b"], "t", k=3)
        days.explain()
        return sorted((x.split, x.trade_date, round(x.ic, 9), round(x.top_mean, 9), tuple(x.names)) for x in days.collect()), re.findall(copying, capsys.readouterr().out)

    whole, none = made()
    monkeypatch.setattr(G, "RANKED", 20)
    small, tasks = made()
    assert small == whole and none == [] and len(tasks) == 2 and all(int(n) >= 16 * 12 * 2 / 20 for n in tasks)  # once for directions, once for figures
