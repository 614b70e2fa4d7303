"""Null-safe column expressions; all run in the JVM and none depends on the session's ANSI flag."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: ColumnOrName) -> Column:
    """Double, or null where the value is no finite number."""
    v = col(c).try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def safe_div(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a / b, null for a null or zero denominator."""
    return F.try_divide(col(a), col(b))


def first_of(*cs: ColumnOrName) -> Column:
    return F.coalesce(*map(col, cs))


def null_sum(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a + b with a missing side as 0; null only if both are."""
    a, b = col(a), col(b)
    return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))


def safe_log(c: ColumnOrName) -> Column:
    return F.when(col(c) > 0, F.log(col(c)))


def truthy(c: ColumnOrName) -> Column:
    """1, true, t, yes, y (any case) and non-zero numbers."""
    text = F.lower(F.trim(col(c).cast("string")))
    return F.coalesce(text.isin("1", "true", "t", "yes", "y", "是") | (text.try_cast("double") != 0), F.lit(False))


def parse_date(c: ColumnOrName) -> Column:
    """A date from yyyymmdd (also 20200131.0) or any ISO form, else null."""
    text = F.regexp_replace(F.trim(col(c).cast("string")), r"\.0$", "")
    compact = F.regexp_replace(text, "-", "")
    return F.coalesce(F.try_to_timestamp(F.when(compact.rlike(r"^\d{8}$"), compact), F.lit("yyyyMMdd")).cast("date"), F.try_to_timestamp(text).cast("date"))


def slug(c: ColumnOrName) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def average_rank(value: ColumnOrName, *by: ColumnOrName) -> Column:
    """Rank from 1 with ties sharing the mean rank; null for a null value. One exchange and one sort by the keys."""
    v = col(value)
    order = Window.partitionBy(*(col(b) for b in by)).orderBy(v.asc_nulls_last())
    ties = F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(v.isNotNull(), F.rank().over(order) + (ties - 1) / 2)


def quantile_bucket(position: ColumnOrName, n: ColumnOrName, q: int) -> Column:
    """Bucket 0..q-1 of the position-th (from 1) of n values in order; null if there are fewer than q."""
    p, n = col(position), col(n)
    return F.when(n >= q, F.greatest(F.lit(0), F.ceil((p - 1) * q / (n - 1)) - 1).cast("int"))


def correlation(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Aggregate: Pearson correlation, null for a constant side."""
    return F.try_divide(F.covar_pop(col(a), col(b)), F.stddev_pop(col(a)) * F.stddev_pop(col(b)))


def steady_mean(c: ColumnOrName) -> Column:
    """Aggregate: the mean of a group's values added in ascending order, so that it is the same double whatever order the rows arrive in; for groups whose values fit a list."""
    v = F.array_sort(F.collect_list(col(c).cast("double")))
    return F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), F.size(v))


def gated(value: Column, count_of: ColumnOrName, window: WindowSpec, least: int) -> Column:
    """A window value, null until `least` non-null rows are in the frame."""
    return F.when(F.count(col(count_of)).over(window) >= least, value)


def sample_skew(c: ColumnOrName) -> Column:
    """Aggregate: bias-corrected skewness, null below 3 values or without spread."""
    n, x = F.count(col(c)), col(c)
    g = F.when(F.stddev_pop(x) > 0, F.skewness(x))
    return F.when(n > 2, F.try_divide(g * F.sqrt(n * (n - 1)), n - 2))


def sample_kurtosis(c: ColumnOrName) -> Column:
    """Aggregate: bias-corrected excess kurtosis, null below 4 values or without spread."""
    n, x = F.count(col(c)), col(c)
    g = F.when(F.stddev_pop(x) > 0, F.kurtosis(x))
    return F.when(n > 3, F.try_divide((n - 1) * ((n + 1) * g + 6), (n - 2) * (n - 3)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value in the plan once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def norm_cdf(x: ColumnOrName) -> Column:
    """Standard normal distribution by the complementary error function's Chebyshev fit (error below 1.2e-7)."""

    def tail(z: Column, t: Column) -> Column:
        # fixed values: coefficients of the published fit, lowest power first
        poly = F.lit(0.0)
        for c in reversed((-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)):
            poly = poly * t + c
        return t * F.exp(-z * z + poly) / 2

    def cdf(v: Column) -> Column:
        z = F.abs(v) / F.sqrt(F.lit(2.0))
        upper = let(1 / (1 + 0.5 * z), lambda t: tail(z, t))
        return F.when(v >= 0, 1 - upper).otherwise(upper)

    return let(col(x), cdf)


def norm_ppf(p: ColumnOrName) -> Column:
    """Inverse of the standard normal distribution (rational fit refined by two Newton steps); null outside (0, 1)."""

    def start(t: Column) -> Column:
        # fixed values: coefficients of the published rational fit
        return t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)

    def ppf(v: Column) -> Column:
        q = F.when((v > 0) & (v < 1), F.least(v, 1 - v))
        newton = lambda x: x - (norm_cdf(x) - (1 - q)) / (F.exp(-x * x / 2) / F.sqrt(F.lit(6.283185307179586)))
        x = let(let(let(F.sqrt(-2 * F.log(q)), start), newton), newton)
        return let(x, lambda y: F.when(v >= 0.5, y).otherwise(-y))

    return let(col(p), ppf)


def log_gamma(x: ColumnOrName) -> Column:
    """Logarithm of the gamma function of x > 0: eight steps up the recurrence, then Stirling's series (error below 1e-12)."""

    def stirling(z: Column) -> Column:
        series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
        return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series

    def made(v: Column) -> Column:
        product = v
        for i in range(1, 8):
            product = product * (v + i)
        return stirling(v + 8) - F.log(product)

    return let(col(x).cast("double"), made)


def incomplete_beta(x: ColumnOrName, a: ColumnOrName, b: ColumnOrName, depth: int = 300) -> Column:
    """The regularised incomplete beta function for x in [0, 1], by its continued fraction from the inside out.

    Beyond the mean the mirrored function is taken, where the fraction converges fast; so many levels serve a and b up to some tens of thousands.
    """
    x, a, b = (col(c).cast("double") for c in (x, a, b))
    flip = x > (a + 1) / (a + b + 2)
    u, p, q = F.when(flip, 1 - x).otherwise(x), F.when(flip, b).otherwise(a), F.when(flip, a).otherwise(b)

    def value(s: Column) -> Column:
        v, m, n = s["u"], s["p"], s["q"]

        def level(h: Column, i: Column) -> Column:
            k = F.floor(i / 2)
            even = k * (n - k) * v / ((m + 2 * k - 1) * (m + 2 * k))
            odd = -(m + k) * (m + n + k) * v / ((m + 2 * k) * (m + 2 * k + 1))
            return 1 + F.when(i % 2 == 0, even).otherwise(odd) / h

        fraction = F.aggregate(F.sequence(F.lit(depth), F.lit(1), F.lit(-1)), F.lit(1.0), level)
        front = F.exp(m * F.log(v) + n * F.log(1 - v) + log_gamma(m + n) - log_gamma(m) - log_gamma(n)) / m
        return F.when(v <= 0, 0.0).otherwise(front / fraction)

    part = let(F.struct(u.alias("u"), p.alias("p"), q.alias("q")), value)
    return F.when((x >= 0) & (x <= 1), F.when(flip, 1 - part).otherwise(part))


def t_two_sided(t: ColumnOrName, df: ColumnOrName) -> Column:
    """The probability that Student's t with df degrees of freedom is at least as far from 0; null without freedom."""
    d = F.when(col(df) > 0, col(df).cast("double"))
    return incomplete_beta(d / (d + col(t) * col(t)), d / 2, F.lit(0.5))


def sharpe_error(sharpe: ColumnOrName, n: ColumnOrName, skew: ColumnOrName, excess_kurtosis: ColumnOrName) -> Column:
    """Standard error of a periodic Sharpe ratio; null below 2 periods or for a non-positive variance."""
    s, n, g, k = map(col, (sharpe, n, skew, excess_kurtosis))
    v = 1 - g * s + (k + 2) / 4 * s * s
    return F.when((n > 1) & (v > 0), F.sqrt(v / (n - 1)))


def probabilistic_sharpe(sharpe: ColumnOrName, against: ColumnOrName, n: ColumnOrName, skew: ColumnOrName, excess_kurtosis: ColumnOrName) -> Column:
    return norm_cdf(safe_div(col(sharpe) - col(against), sharpe_error(sharpe, n, skew, excess_kurtosis)))


def expected_max_sharpe(trials: ColumnOrName, variance: ColumnOrName) -> Column:
    """The largest of so many independent Sharpe estimates with that variance; 0 for a single trial."""
    n, gamma = col(trials), 0.5772156649015329
    share = F.try_divide(F.lit(1.0), n)
    z = (1 - gamma) * norm_ppf(1 - share) + gamma * norm_ppf(1 - F.exp(F.lit(-1.0)) * share)
    return F.when(n > 1, F.sqrt(F.greatest(col(variance), F.lit(0.0))) * z).otherwise(F.lit(0.0))


# The seventeen ratios with their inputs, (added, subtracted) over the denominator.
RATIOS = {
    "profit_margin": (("net_profit",), "revenue"),
    "operating_margin": (("operating_profit",), "revenue"),
    "cfo_margin": (("cash_flow_from_operating_activities",), "revenue"),
    "cfo_to_profit": (("cash_flow_from_operating_activities",), "net_profit"),
    "asset_turnover": (("revenue",), "total_assets"),
    "roa": (("net_profit",), "total_assets"),
    "leverage": (("total_liabilities",), "total_assets"),
    "cfo_to_assets": (("cash_flow_from_operating_activities",), "total_assets"),
    "debt_to_assets": (("total_debt",), "total_assets"),
    "debt_to_equity": (("total_debt",), "total_equity"),
    "cash_to_assets": (("cash_and_equivalents",), "total_assets"),
    "goodwill_to_assets": (("goodwill",), "total_assets"),
    "accrual_ratio": (("net_profit", "cash_flow_from_operating_activities"), "total_assets"),
    "receivables_to_revenue": (("accounts_receivable",), "revenue"),
    "inventory_to_revenue": (("inventory",), "revenue"),
    "working_capital_to_assets": (("current_assets", "current_liabilities"), "total_assets"),
    "net_debt_to_assets": (("total_debt", "cash_and_equivalents"), "total_assets"),
}


def financial_ratios(columns: list[str]) -> dict[str, Column]:
    """Those of RATIOS whose inputs are among the columns; null for a null input or a zero denominator."""
    have = set(columns)
    top = lambda names: F.col(names[0]) - F.col(names[1]) if len(names) > 1 else F.col(names[0])
    return {n: safe_div(top(names), below) for n, (names, below) in RATIOS.items() if have.issuperset((*names, below))}


def compose(columns: list[str], candidates: list[tuple[str, str]]) -> Column | None:
    """The first candidate (column, how) that is among the columns, as it is (identity), negative (neg), or log or negative log of a positive value."""
    for name, how in candidates:
        if name in columns:
            c = F.col(name).cast("double")
            return {"identity": c, "neg": -c, "log": safe_log(c), "neg_log": -safe_log(c)}[how]
    return None


def tokens(c: ColumnOrName) -> Column:
    """The different stripped non-empty parts of a comma, semicolon, bar or blank separated text, in order; null gives none."""
    parts = F.split(F.coalesce(col(c).cast("string"), F.lit("")), r"[,;|\s]+")
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))


def connect_flag(c: ColumnOrName) -> Column:
    """Whether any part of a flag list says true; null for a list without parts."""
    parts = F.transform(tokens(c), lambda x: F.lower(x))
    return F.when(F.size(parts) > 0, F.arrays_overlap(parts, F.array(*map(F.lit, ("true", "1", "yes", "y", "t")))))


def json_first(c: ColumnOrName, *paths: str) -> Column:
    """The value at the first of the dotted paths of a JSON text that is there and not empty, as text."""
    found = [F.get_json_object(col(c), "$." + p) for p in paths]
    return F.coalesce(*(F.when(f != "", f) for f in found))


def cohort_key(*cs: ColumnOrName) -> Column:
    """Twelve hex digits that stand for the values of the columns, nulls told apart from empty texts."""
    return F.substring(F.md5(F.to_json(F.array(*(col(c).cast("string") for c in cs)))), 1, 12)


def feature_window(c: ColumnOrName) -> Column:
    """The window in a feature's name such as sma_20_diff: its first number, null for none."""
    return F.regexp_extract(col(c), r"_(\d+)(?:_|$)", 1).try_cast("int")


def padded_code(c: ColumnOrName, width: int = 5) -> Column:
    """The digits of a code such as 700.HK, padded with zeros in front; other texts as they are."""
    head = F.split_part(F.trim(col(c).cast("string")), F.lit("."), F.lit(1))
    return F.when(head.rlike(r"^\d+$") & (F.length(head) < width), F.lpad(head, width, "0")).otherwise(head)
