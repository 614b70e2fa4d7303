"""Sample weights and leakage-aware resampling. Fold tables are calendar-sized; rows follow by semi join on dates."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def date_weights(df: DataFrame) -> DataFrame:
    """weight 1 / rows of the date: every date counts alike."""
    n = df.groupBy("trade_date").agg(F.count(F.lit(1)).alias("_n"))
    return df.join(F.broadcast(n), "trade_date").withColumn("weight", 1 / F.col("_n")).drop("_n")  # a row for each date


def decay_weights(df: DataFrame, half_life_days: float | None = None, floor: float = 0.0, rate: float | None = None) -> DataFrame:
    """Weights halving with age (or times 1 - rate for each day of it), at least `floor`, mean 1 over dates, then shared among each date's rows."""
    if (half_life_days is None) == (rate is None) or (rate is not None and not 0 <= rate < 1) or (half_life_days is not None and half_life_days <= 0):
        raise ValueError("give either a positive half life or a rate from 0 to below 1")
    base, scale = (0.5, half_life_days) if rate is None else (1 - rate, 1.0)
    n = df.groupBy("trade_date").agg(F.count(F.lit(1)).alias("_n"))
    last = n.agg(F.max("trade_date").alias("_last"))
    raw = n.join(F.broadcast(last)).withColumn("_raw", F.greatest(F.pow(F.lit(base), F.datediff("_last", "trade_date") / scale), F.lit(floor)))
    mean = raw.agg(F.avg("_raw").alias("_mean"))
    each = raw.join(F.broadcast(mean)).select("trade_date", (F.col("_raw") / F.col("_mean") / F.col("_n")).alias("weight"))
    return df.join(F.broadcast(each), "trade_date")  # a row for each date


@dataclass(frozen=True)
class Split:
    """Half-open ranges of date indices."""

    train: tuple[int, int]
    test: tuple[int, int]


def steps(value: float, n: int) -> int:
    """A size given as a count or as a share of n."""
    return int(value) if value >= 1 else int(n * value)


def train_test(n: int, test: float, gap: int = 0) -> Split:
    cut = int(n * (1 - test))
    return Split((0, max(0, cut - gap)), (cut, n))


def time_series(n: int, folds: int, gap: int = 0, window: int | None = None) -> list[Split]:
    """Expanding (or rolling) training ranges before equal test ranges at the end."""
    size = n // (folds + 1)
    if size < 1:
        return []
    out = []
    for i in range(folds):
        lo = n - (folds - i) * size
        stop = max(0, lo - gap)
        out.append(Split((max(0, stop - window) if window else 0, stop), (lo, lo + size)))
    return out


def walk_forward(n: int, test: float, windows: int, step: float | None = None, gap: int = 0, anchor_end: bool = True) -> list[Split]:
    """Successive test ranges, the last one ending at n when anchored there."""
    size = max(1, steps(test, n))
    move = max(1, steps(step, n)) if step else size
    first = n - size - (windows - 1) * move if anchor_end else max(1, n - size * windows)
    made = [Split((0, max(0, lo - gap)), (lo, min(n, lo + size))) for lo in (first + i * move for i in range(windows)) if lo >= 0 and lo < n]
    return [s for s in made if s.train[1] > 0]


@dataclass(frozen=True)
class GroupSplit:
    test: tuple[int, ...]


def combinatorial(groups: int, tests: int) -> list[GroupSplit]:
    return [GroupSplit(c) for c in combinations(range(groups), tests)]


def paths(groups: int, tests: int) -> list[list[tuple[int, int]]]:
    """C(groups - 1, tests - 1) paths; each holds a (group, split) for every group and uses each such pair once."""
    used: list[list[int]] = [[i for i, s in enumerate(combinatorial(groups, tests)) if g in s.test] for g in range(groups)]
    return [[(g, used[g][p]) for g in range(groups)] for p in range(comb(groups - 1, tests - 1))]


def rows_of(df: DataFrame, cal: DataFrame, lo: int, hi: int) -> DataFrame:
    """Rows whose date has an index in [lo, hi)."""
    return df.join(F.broadcast(cal.filter((F.col("idx") >= lo) & (F.col("idx") < hi)).select("trade_date")), "trade_date", "left_semi")
