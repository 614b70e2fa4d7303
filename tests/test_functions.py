"""Special functions and windows against direct computations."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from xpanel.functions import exprs as X
from xpanel.operators import portfolio as P
from xpanel.operators import returns as T
from xpanel.operators import timeseries as TS


def day(i):
    return date(2020, 1, 1) + timedelta(days=i)


def tail(t, v):
    """Two-sided probability for whole degrees of freedom, by the finite series."""
    th = math.atan(abs(t) / math.sqrt(v))
    if v % 2 == 0:
        term, total = 1.0, 1.0
        for k in range(1, v // 2):
            term *= (2 * k - 1) / (2 * k) * math.cos(th) ** 2
            total += term
        return 1 - math.sin(th) * total
    term, total = math.cos(th), 0.0
    for k in range((v - 1) // 2):
        term *= 1 if k == 0 else 2 * k / (2 * k + 1) * math.cos(th) ** 2
        total += term
    return 1 - 2 / math.pi * (th + math.sin(th) * total)


def test_student_tail(spark):
    rows = [(t, v) for t in (0.0, 0.1, 1.0, -2.5, 6.0) for v in (1, 2, 3, 4, 10, 37, 78, 999, 20_000)]
    df = spark.createDataFrame([*rows, (1.0, 0), (None, 5)], "t double, v int")
    for r in df.select("t", "v", X.t_two_sided("t", "v").alias("p")).collect():
        assert (r.p is None) if r.v == 0 or r.t is None else abs(r.p - tail(r.t, r.v)) < 1e-9, r


def test_gamma(spark):
    df = spark.createDataFrame([(x,) for x in (0.1, 0.5, 1.0, 2.5, 10.0, 171.0, 5000.5)], "x double")
    assert all(abs(r.g - math.lgamma(r.x)) < 1e-11 * max(1, abs(r.g)) for r in df.select("x", X.log_gamma("x").alias("g")).collect())


@pytest.mark.parametrize("n", [1, 2, 3, 7, 12, 16])
def test_rolling_drawdown_equals_a_scan(spark, n):
    r = np.random.default_rng(n).normal(0.01, 0.1, 40).tolist()
    r[20] = None
    got = [x.max_drawdown for x in T.rolling_drawdown(spark.createDataFrame([(day(i), v) for i, v in enumerate(r)], "trade_date date, r double"), n).orderBy("trade_date").collect()]
    for i, mine in enumerate(got):
        some = r[max(0, i - n + 1) : i + 1]
        if len(some) < n or None in some:
            assert mine is None
            continue
        nav = np.cumprod([1.0, *(1 + v for v in some)])
        assert abs(mine - min(0, (nav / np.maximum.accumulate(nav) - 1).min())) < 1e-12


def test_exponential_means_over_many_blocks(spark):
    """Long histories, nulls at the start and inside, a mean of one row, and two symbols."""
    r = np.random.default_rng(5)
    rows = [(s, day(i), None if i < k or i % 7 == 3 else float(r.normal())) for s, k, n in (("a", 5, 400), ("b", 0, 64), ("c", 0, 65), ("d", 3, 3), ("e", 2, 90)) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, trade_date date, close double").repartition(3)
    for n in (1, 2, 12, 200):
        got = {(x.symbol, x.trade_date): x.e for x in TS.ema(df, "close", n, "e").collect()}
        assert len(got) == len(rows)
        v, last = None, None
        for s, d, x in rows:
            v = None if s != last else v
            last, w = s, 2 / (n + 1)
            v = v if x is None else x if v is None else v + w * (x - v)
            assert got[s, d] == v or abs(got[s, d] - v) < 1e-9, (n, s, d)


def greedy(names, held, k, exit_, entry, cap):
    """One date's holdings, step by step."""
    if held is None or (exit_ <= 0 and entry <= 0):
        wanted = names
    else:
        kept = [x for x in names[: k + exit_] if x[0] in held]
        rest = [x for x in [*names[: max(0, k - entry)], *names] if x not in kept]
        wanted = [*kept, *dict.fromkeys(rest)][: max(k, len(kept))]
    out = []
    for x in wanted:
        if len(out) < k and (cap is None or x[1] is None or sum(y[1] == x[1] for y in out) < cap):
            out.append(x)
    return out


@pytest.mark.parametrize("k,exit_,entry,cap", [(3, 2, 1, None), (3, 2, 1, 1), (4, 3, 2, 2), (4, 0, 2, 1), (3, 0, 0, 1), (2, 1, 2, None)])
def test_holdings_equal_a_walk_over_dates(spark, k, exit_, entry, cap):
    r = np.random.default_rng(k + exit_)
    rows = [(day(d), f"n{i}", float(r.normal()), 10.0, None if i == 4 else f"g{i % 3}") for d in range(12) for i in range(9)]
    df = spark.createDataFrame(rows, "trade_date date, symbol string, s double, close double, g string").repartition(3)
    c = P.Constraints(group="g", most_of_group=cap) if cap else P.Constraints()
    got = sorted((x.trade_date, x.symbol) for x in P.buffered(df, k, exit_, entry, c=c).collect())
    want, held = [], None
    for d in range(12):
        names = [(x[1], x[4]) for x in sorted((x for x in rows if x[0] == day(d)), key=lambda x: (-x[2], x[1]))]
        chosen = greedy(names, held, k, exit_, entry, cap)
        held = {x[0] for x in chosen}
        want += [(day(d), n) for n in held]
    assert got == sorted(want)
    assert P.buffered(df.limit(0), k, exit_, entry, c=c).count() == 0


@pytest.mark.parametrize("kind", ["tail", "ties", "few", "none"])
def test_quantiles_of_a_whole_table(spark, kind):
    from xpanel.operators import ranks as RK

    r = np.random.default_rng(1)
    v = {"tail": np.exp(r.normal(0, 4, 5000)), "ties": np.round(r.normal(0, 1, 5000)), "few": np.array([3.0, 1.0]), "none": np.zeros(0)}[kind]
    df = spark.createDataFrame([(str(i), float(x)) for i, x in enumerate(v)] + [("n", None), ("m", float("nan"))], "symbol string, v double").repartition(4)
    shares = [0.0, 0.1, 0.333, 0.5, 0.9, 1.0]
    got = {x.share: x.value for x in RK.quantiles(df, "v", shares).collect()}
    assert len(got) == (len(shares) if len(v) else 0) and all(math.isclose(got[p], np.quantile(v, p), rel_tol=1e-12, abs_tol=1e-12) for p in got)
    placed = RK.numbered(df.filter(~F.isnan("v")), "v", "symbol")
    order = sorted(range(len(v)), key=lambda i: (v[i], str(i)))
    assert {x.symbol: x.position for x in placed.collect()} == {str(i): p + 1 for p, i in enumerate(order)}
    if kind == "tail":
        sizes = [x["count"] for x in df.filter("v is not null").groupBy(RK.bins(df, "v")).count().collect()]
        assert len(sizes) > 500 and max(sizes) < 40  # as even on a heavy tail
        parts = RK.part_quantiles(placed.withColumn("part", F.floor((F.col("position") - 1) / 2000)), "part", "v", {"lo": 0.0, "mid": 0.5})
        s = np.sort(v)
        assert {x.part: (x.n, x.lo, x.mid) for x in parts.collect()} == {i: (len(y), y[0], float(np.quantile(y, 0.5))) for i, y in enumerate((s[:2000], s[2000:4000], s[4000:]))}


def test_a_steady_mean_does_not_depend_on_the_order_of_rows(spark):
    v = [1e16, 1.0, 1.0, 3.0, 0.1, 0.7]
    rows = [("a", x) for x in v] + [("b", x) for x in reversed(v)] + [("c", x) for x in sorted(v, reverse=True)] + [("d", None), ("n", float("nan")), ("n", 1.0)]
    df = spark.createDataFrame(rows, "symbol string, v double").coalesce(1)
    got = {r.symbol: r for r in df.groupBy("symbol").agg(F.avg("v").alias("plain"), X.steady_mean("v").alias("steady")).collect()}
    assert len({got[s].plain for s in "abc"}) > 1 and len({got[s].steady for s in "abc"}) == 1
    assert math.isclose(got["a"].steady, sum(v) / len(v), rel_tol=1e-12) and got["d"].steady is None and math.isnan(got["n"].steady)
