"""Hand-computed panels and properties of the resampling schemes."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from xpanel.functions import exprs as X
from xpanel.operators import crosssection as CS
from xpanel.operators import joins as J
from xpanel.operators import portfolio as P
from xpanel.operators import signals as S
from xpanel.operators import splits as SP


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(n)


def test_two_name_backtest(spark):
    df = spark.createDataFrame([(day(0), "A", 2.0, 100.0), (day(0), "B", 1.0, 100.0), (day(1), "A", 2.0, 110.0), (day(1), "B", 1.0, 90.0)], "trade_date date, symbol string, s double, close double")
    [row] = P.backtest(df, 1, bps=10).collect()
    assert math.isclose(row.gross, 0.10) and math.isclose(row.net, 0.099) and math.isclose(row.turnover, 1.0)


def test_perfect_scores_have_unit_ic(spark):
    df = spark.createDataFrame([(day(d), n, float(i), float(i)) for d in range(2) for i, n in enumerate("ABC")], "trade_date date, symbol string, s double, t double")
    assert [(round(r.ic, 9), r.n) for r in S.daily_ic(df).collect()] == [(1.0, 3)] * 2
    assert S.daily_ic(df.withColumn("t", F.lit(1.0))).count() == 0


def test_average_ranks_and_buckets(spark):
    df = spark.createDataFrame([(day(0), n, v) for n, v in zip("ABCDE", (1.0, 2.0, 2.0, None, 5.0))], "trade_date date, symbol string, v double")
    got = {r.symbol: r.k for r in df.select("symbol", X.average_rank("v", "trade_date").alias("k")).collect()}
    assert got == {"A": 1.0, "B": 2.5, "C": 2.5, "D": None, "E": 4.0}
    assert [r.b for r in df.select("symbol", CS.bucket("v", 2).alias("b")).orderBy("symbol").collect()] == [0, 0, 1, None, 1]


def test_asof_takes_the_latest_known_row(spark):
    left = spark.createDataFrame([("A", day(5)), ("A", day(1)), ("B", day(5))], "symbol string, trade_date date")
    right = spark.createDataFrame([("A", day(2), 1.0), ("A", day(5), 2.0)], "symbol string, trade_date date, v double")
    got = {(r.symbol, r.trade_date): (r.v, r.age) for r in J.asof(left, right, ["symbol"], "trade_date", ["v"], "age").collect()}
    assert got == {("A", day(5)): (2.0, 0), ("A", day(1)): (None, None), ("B", day(5)): (None, None)}


def test_buffer_keeps_a_name_inside_the_band(spark):
    scores = {0: "ABC", 1: "BCA", 2: "CBA"}
    df = spark.createDataFrame([(day(d), n, float(-i), 1.0) for d, names in scores.items() for i, n in enumerate(names)], "trade_date date, symbol string, s double, close double")
    held = {}
    for r in P.buffered(df, 1, exit_=1, entry=0).collect():
        held.setdefault(r.trade_date, []).append(r.symbol)
    assert held == {day(0): ["A"], day(1): ["B"], day(2): ["B"]}


def test_cash_scales_buys(spark):
    orders = spark.createDataFrame([(day(0), 1, "A", 0.1, day(0)), (day(0), 2, "B", 0.3, day(0))], "rebalance_date date, order_id long, symbol string, requested double, start date")
    days = spark.createDataFrame([("A", day(0), 1.0), ("B", day(0), 1.0)], "symbol string, trade_date date, capacity double")
    assert {r.order_id: round(r.filled, 9) for r in P.buy_fills(orders, days, cash=0.2).collect()} == {1: 0.05, 2: 0.15}


def test_buys_of_every_rebalance_date(spark):
    from xpanel.plans import portfolio_queries as Q
    from xpanel.plans.panels import scored

    data = "/root/testdata/sf0.001"
    room = {(r.symbol, r.trade_date): r.capacity for r in Q._capacity(spark, data).collect()}
    orders = {}
    for r in P.select(scored(spark, data), 4).select("trade_date", "symbol").collect():
        orders.setdefault(r.trade_date, []).append(r.symbol)
    want = {}
    for date, names in orders.items():
        cash, left = 0.2, {s: 1 / len(names) for s in names}
        for d in sorted({d for s, d in room if s in left and d >= date})[:5]:
            ask = {s: min(left[s], room.get((s, d), 0.0)) for s in names}
            share = min(1.0, cash / sum(ask.values())) if sum(ask.values()) else 0.0
            for s in names:
                want[date, int(s), d] = ask[s] * share
                left[s] -= ask[s] * share
            cash = max(0.0, cash - share * sum(ask.values()))
    got = {(r.rebalance_date, r.order_id, r.trade_date): r.filled for r in Q.buy_fills(spark, data).collect()}
    assert len(orders) > 50 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_cpcv_counts():
    assert len(SP.combinatorial(8, 2)) == 28
    paths = SP.paths(8, 2)
    assert len(paths) == 7 and all(len(p) == 8 for p in paths)
    assert len({pair for p in paths for pair in p}) == 56


@pytest.mark.parametrize("n", [12, 37, 100])
def test_folds_do_not_leak(n):
    for f in SP.time_series(n, 5, gap=2) + SP.walk_forward(n, 0.1, 3, gap=2):
        assert f.train[1] + 2 <= f.test[0] and f.test[1] <= n


def test_normal_functions(spark):
    p = spark.createDataFrame([(0.001,), (0.3,), (0.5,), (0.99,)], "p double")
    for r in p.select("p", X.norm_cdf(X.norm_ppf("p")).alias("back")).collect():
        assert abs(r.p - r.back) < 1e-6


def test_execution_of_two_names(spark):
    """Room of 5 % of the median amount: A fits in four days, B runs out of time."""
    from xpanel.operators import execution as E

    positions = spark.createDataFrame([(day(0), day(1), n, 0.10) for n in "AB"], "rebalance_date date, entry_date date, symbol string, weight double")
    room = spark.createDataFrame([(day(d), n, 0.05 * a) for d in range(7) for n, a in (("A", 5e5), ("B", 1e5))], "trade_date date, symbol string, room double")
    made = E.progress(E.orders(positions, room, buy_days=5), room, {"m": 1e6})
    got = {r.symbol: r for r in E.closed(made).collect()}
    assert math.isclose(got["A"].filled, 0.1) and got["A"].status == "filled" and got["A"].fill_days == 4
    assert math.isclose(got["B"].filled, 0.025) and got["B"].status == "cancelled_buy_deadline"
    [s] = E.summarized(E.closed(made)).collect()
    assert math.isclose(s.unfilled_buy_notional, 75_000) and s.orders == 2
    done = E.fills(made).collect()
    assert len(done) == 9 and math.isclose(sum(f.fill_weight for f in done), 0.125)
    assert E.progress(E.orders(positions.limit(0), room), room, {"m": 1e6}).count() == 0


def test_execution_of_changing_targets(spark):
    from xpanel.operators import execution as E

    positions = spark.createDataFrame([(day(0), day(0), "A", 0.7), (day(0), day(0), "A", 0.3), (day(3), day(3), "A", 0.25), (day(3), day(3), "B", 0.75), (day(6), day(6), "C", 0.5)], "rebalance_date date, entry_date date, symbol string, weight double")
    room = spark.createDataFrame([(day(d), n, a) for d in range(9) for n, a in (("A", 0.5), ("B", 0.2), ("C", None))], "trade_date date, symbol string, room double")
    got = {(r.rebalance_date, r.side, r.symbol): (round(r.requested, 9), round(r.filled, 9), r.fill_days, r.status) for r in E.closed(E.progress(E.orders(positions, room, 2), room, {"x": 1.0})).collect()}
    assert got == {
        (day(0), "buy", "A"): (1.0, 1.0, 2, "filled"), (day(3), "sell", "A"): (0.75, 0.75, 2, "filled"), (day(3), "buy", "B"): (0.75, 0.4, 2, "cancelled_buy_deadline"),
        (day(6), "sell", "A"): (0.25, 0.25, 1, "filled"), (day(6), "sell", "B"): (0.75, 0.6, 3, "delayed_sell"), (day(6), "buy", "C"): (0.5, 0.0, 0, "abandoned_zero_fill"),
    }


def test_legs_add_up_and_take_no_name_twice(spark):
    scores = {0: (3.0, 2.0, 1.0), 1: (3.0, 2.0, 1.0)}
    df = spark.createDataFrame([(day(d), n, s, p) for d, row in scores.items() for n, s, p in zip("ABC", row, (100.0 + 10 * d, 100.0, 100.0 - 20 * d))], "trade_date date, symbol string, s double, close double")
    [row] = P.backtest(df, 1, bps=0, short_k=1).collect()
    assert math.isclose(row.gross, 0.1 + 0.2) and math.isclose(row.turnover, 2.0)
    assert P.backtest(df, 3, short_k=1).count() == 0  # no name is left to sell


def test_smoothing_starts_late_and_bridges_nulls(spark):
    from xpanel.operators import timeseries as TS

    df = spark.createDataFrame([(day(i), "A", v) for i, v in enumerate((None, 1.0, None, 3.0))], "trade_date date, symbol string, close double")
    assert [r.e for r in TS.ema(df, "close", 3, "e").orderBy("trade_date").collect()] == [None, 1.0, 1.0, 2.0]
    rising = spark.createDataFrame([(day(i), "A", float(i)) for i in range(5)], "trade_date date, symbol string, close double")
    assert [r.rsi for r in TS.rsi(rising, "close", 3).orderBy("trade_date").collect()] == [None, None, 100.0, 100.0]


def test_numbers_without_one_task(spark):
    from xpanel.operators import ranks as RK

    df = spark.createDataFrame([(str(i), v) for i, v in enumerate((5.0, 1.0, 1.0, None, 9.0))], "symbol string, v double")
    assert {r.symbol: (r.position, r.n) for r in RK.numbered(df, "v", "symbol").collect()} == {"1": (1, 4), "2": (2, 4), "0": (3, 4), "4": (4, 4)}


def test_ridge_equals_the_closed_form(spark):
    import numpy as np
    from xpanel.operators import models as M

    r = np.random.default_rng(1)
    x = r.normal(size=(60, 2))
    y = x @ [1.5, -2.0] + 0.3 + r.normal(size=60)
    df = spark.createDataFrame([(day(i % 6), str(i), float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))], "trade_date date, symbol string, a double, b double, t double")
    model = M.fit(df, "ridge", ["a", "b"], "t", alpha=5.0)
    c = x - x.mean(0)
    want = np.linalg.solve(c.T @ c + 5.0 * np.eye(2), c.T @ (y - y.mean()))
    assert np.allclose(model.coefficients.toArray(), want, atol=1e-6)
    assert M.fit(df, "elasticnet", ["a", "b"], "t").coefficients.size == 2
    ranked = M.predict(M.fit(df, "ranker", ["a", "b"], "t", trees=3), df, ["a", "b"])
    assert ranked.count() == 60 and ranked.filter("pred is null").count() == 0


def test_modelling_rows_and_labels_on_odd_tables(spark):
    from xpanel.operators import dataset as DS

    spec = DS.PanelSpec("d", "s", "p", None, None)
    df = spark.createDataFrame([("2020-01-01", " A ", "nan"), ("2020-01-02", "", "1"), (None, "A", "1"), ("2020-01-03", "B", "2.5")], "d string, s string, p string")
    assert sorted(map(tuple, spec.canonical(df).collect()), key=str) == sorted([(day(0), "A", None), (day(2), "B", 2.5)], key=str)
    with pytest.raises(ValueError):
        DS.PanelSpec("d", "s", "q").canonical(df)
    empty = spark.createDataFrame([], "trade_date date, symbol string, close double, f double, t double")
    assert DS.modeling_rows(empty, DS.Recipe(("f",), transform="rank", rebalance="month", least_symbols=2)).count() == 0
    assert DS.holdout(empty, 0.5).count() == 0


def test_promotion_reasons(spark):
    from xpanel.operators import research as Q

    rows = [("a", "x", "x", 1.0, 1.0, 20), ("b", "x", "y", 1.0, 1.0, 20), ("c", "x", "x", None, 1.0, 20), ("d", "x", "x", 0.5, 1.0, 20), ("e", "x", "x", 1.0, 1.0, 5)]
    df = spark.createDataFrame(rows, "run string, b_key string, c_key string, c_ic double, b_ic double, c_periods int")
    got = {r.run: (r.verdict, r.reasons) for r in Q.promotion(df, ["ic"], ["key"], {"periods": 10}, {"ic": 0.1}).collect()}
    assert got == {"a": ("promotable", ""), "b": ("non_comparable", "differs:key"), "c": ("rejected", "missing:ic,behind:ic"), "d": ("reviewable", "behind:ic"), "e": ("rejected", "below:periods")}


def test_left_over_cash_goes_lot_by_lot(spark):
    from xpanel.operators import live as L

    cols = "scenario string, capital double, symbol string, price double, round_lot double, lots long, target_value double, valuation string, tradable boolean"
    rows = [("x", 100.0, "A", 1.0, 10.0, 2, 33.0, "NEUTRAL", True), ("x", 100.0, "B", 1.0, 15.0, 1, 33.0, "LOW", True), ("x", 100.0, "C", 1.0, 5.0, 0, 33.0, "NEUTRAL", False), ("y", 10.0, "A", None, 10.0, 0, 10.0, "LOW", True)]
    df = spark.createDataFrame(rows, cols)
    got = {(r.scenario, r.symbol): (r.lots, r.extra) for r in L.secondary_fill(df).collect()}
    assert got == {("x", "A"): (3, 1), ("x", "B"): (2, 1), ("x", "C"): (0, 0), ("y", "A"): (0, 0)}
    tight = {r.symbol: (r.lots, r.cash_left) for r in L.secondary_fill(df.filter("scenario = 'x'"), L.Filling(buffer=45.0)).collect()}
    assert tight["B"] == (2, 5.0) and tight["A"] == (2, 5.0)  # the low valuation first, then too little is left
    over = L.Filling(most_over=10.0)
    assert {r.symbol: r.lots for r in L.secondary_fill(df.filter("scenario = 'x'"), over).collect()} == {"A": 3, "B": 2, "C": 0}


def greedy(rows, rule):
    """lots of every name and the cash left, name by name."""
    rank = {"LOW": 0, "NEUTRAL": 1, "HIGH": 2, "EXTREME": 3, "NA": 4}
    cash, steps, out, line = rows[0][1] - sum(r[3] * r[4] * r[5] for r in rows), rule.steps or 10**9, {}, []
    for _, _, symbol, price, lot, lots, goal, valuation, tradable in rows:
        cost, gap = price * lot, goal - lots * lot * price
        below = math.floor(gap / cost + 1e-12)
        rest = gap - below * cost
        over = rule.most_over is not None and rest > 1e-9 and cost - rest < rest - 1e-9 and cost - rest <= rule.most_over + 1e-9
        line.append((rule.calm_first and valuation in ("HIGH", "EXTREME"), rank[valuation], abs(gap - cost), cost, symbol, below + over if tradable and gap > 1e-9 else 0))
    for *_, cost, symbol, wanted in sorted(line):
        n = max(0, min(wanted, math.floor((cash + 1e-9) / (cost + rule.fee)), steps)) if wanted else 0
        cash, steps, out[symbol] = cash - n * (cost + rule.fee), steps - n, n
    return out, cash


@pytest.mark.parametrize("seed,steps", [(1, None), (2, None), (3, 25), (4, 1), (5, None)])
def test_left_over_cash_of_many_names_equals_one_by_one(spark, capsys, seed, steps):
    """Costs from 1 to 100,000, so that cash runs short of large lots long before it does of small ones; equal names too."""
    from xpanel.operators import live as L

    r = np.random.default_rng(seed)
    rows = []
    for scenario, capital in (("none", 40.0), ("little", 5000.0), ("some", 300000.0), ("all", 1e9)):
        for i in range(300):
            price = float(round(10 ** r.uniform(0, 5), 2)) if i % 5 else 77.0
            goal = price * float(round(r.uniform(0, 4), 3)) if i % 5 else 200.0
            rows.append((scenario, capital, str(i), price, 1.0, 0, goal, ("LOW", "NEUTRAL", "HIGH", "NA")[i % 4], i % 11 > 0))
    df = spark.createDataFrame(rows, "scenario string, capital double, symbol string, price double, round_lot double, lots long, target_value double, valuation string, tradable boolean")
    rule = L.Filling(steps=steps, fee=2.0, most_over=1000.0, calm_first=True)
    made = L.secondary_fill(df, rule)
    made.explain()
    assert "collect_list" not in capsys.readouterr().out  # no group holds all names
    got = {(x.scenario, x.symbol): x for x in made.collect()}
    assert len(got) == len(rows)
    for s in ("none", "little", "some", "all"):
        want, cash = greedy([x for x in rows if x[0] == s], rule)
        assert {n: got[s, n].extra for n in want} == want
        assert math.isclose(got[s, "1"].cash_left, cash, rel_tol=1e-9, abs_tol=1e-6)


def test_summary_of_short_and_even_series(spark):
    from xpanel.operators import returns as T

    cols = "trade_date date, r double, entry_idx long, exit_idx long, planned_exit_idx long"
    [none] = T.summary(spark.createDataFrame([], cols), 252).collect()
    assert none.periods == 0 and none.sharpe is None and len(none) == 22
    [lost] = T.summary(spark.createDataFrame([(day(0), 0.1, 0, 5, 5), (day(5), -1.0, 5, 11, 10), (day(10), 0.5, 11, 15, 15)], cols), 252).collect()
    assert lost.total_return == -1.0 and lost.ann_return == -1.0 and lost.calmar == -1.0 and lost.periods_with_delayed_exit == 1
    assert lost.drawdown_duration == 1.0 and lost.recovery_time is None and math.isclose(lost.avg_holding, 5.0)


def test_calendar_windows_go_by_date(spark):
    from xpanel.operators import timeseries as TS

    rows = [(dt.date(2018, 1, 31), 1.0), (dt.date(2019, 1, 31), 2.0), (dt.date(2020, 1, 31), 4.0), (dt.date(2020, 2, 29), None)]
    df = spark.createDataFrame([(d, "A", v) for d, v in rows], "trade_date date, symbol string, v double")
    got = {r.trade_date: (r.m, r.c) for r in TS.calendar_cagr(df.withColumn("m", TS.calendar_stat("v", 2, "mean")), "v", 2, "c").collect()}
    assert got == {dt.date(2018, 1, 31): (None, None), dt.date(2019, 1, 31): (1.5, None), dt.date(2020, 1, 31): (3.0, 1.0), dt.date(2020, 2, 29): (3.0, None)}


def test_deflated_sharpe_equals_the_textbook(spark):
    from statistics import NormalDist

    n, trials, variance, sharpe, skew, kurt = 60, 20, 0.04, 0.3, -0.2, 1.5
    z, gamma = NormalDist().inv_cdf, 0.5772156649015329
    best = math.sqrt(variance) * ((1 - gamma) * z(1 - 1 / trials) + gamma * z(1 - 1 / (trials * math.e)))
    error = math.sqrt((1 - skew * sharpe + (kurt + 2) / 4 * sharpe**2) / (n - 1))
    df = spark.createDataFrame([(n, trials, variance, sharpe, skew, kurt)], "n int, trials int, v double, s double, g double, k double")
    [row] = df.withColumn("best", X.expected_max_sharpe("trials", "v")).select("best", X.probabilistic_sharpe("s", "best", "n", "g", "k").alias("dsr")).collect()
    assert math.isclose(row.best, best, rel_tol=1e-5) and math.isclose(row.dsr, NormalDist().cdf((sharpe - best) / error), rel_tol=1e-5)


def test_permutation_keeps_each_date_and_drops_what_counts(spark):
    from xpanel.operators import research as Q

    rows = [(day(d), f"{i:02d}", float(i), float((7 * i) % 20), float(i)) for d in range(8) for i in range(20)]
    df = spark.createDataFrame(rows, "trade_date date, symbol string, a double, b double, t double")
    got = {r.family: r for r in Q.permutation_drops(df, {"useful": ["a"], "idle": ["b"]}, {"a": 1.0, "b": 0.0}, 3).collect()}
    assert got["base"].mean_return == 18.0 and got["base"].drop == got["idle"].drop == 0.0 and got["useful"].drop > 3
    dealt = CS.permute(df, "a", 3).groupBy("trade_date").agg(F.sort_array(F.collect_list("permuted")).alias("x")).collect()
    assert all(r.x == [float(i) for i in range(20)] for r in dealt)
