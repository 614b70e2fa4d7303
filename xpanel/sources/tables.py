"""Readers that bring tables with varying headers to one shape, and writers. Rows stay distributed throughout."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import parse_date, truthy
from ..operators.joins import keep_last

# Accepted headers, the first that is present counts.
UNIVERSE_DATES = ("trade_date", "date", "rebalance_date")
UNIVERSE_SYMBOLS = ("symbol", "ts_code", "stock_ticker", "order_book_id")
UNIVERSE_SELECTED = ("selected", "selected_bool", "selected_flag", "is_selected")
RETURN_DATES = ("trade_date", "date", "exit_date", "rebalance_date")
RETURN_VALUES = ("benchmark_return", "return", "net_return", "active_benchmark_return")
PERIOD = ("rebalance_date", "entry_date", "exit_date")


def present(df: DataFrame, names: Sequence[str], needed: bool = True) -> str | None:
    """The column that has the first of these names, in any case."""
    have = {c.lower(): c for c in df.columns}
    found = next((have[n] for n in names if n in have), None)
    if needed and found is None:
        raise ValueError(f"needs one of: {', '.join(names)}")
    return found


def projected(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Those of the columns that a Parquet or CSV (with header) path has; only they are read."""
    df = spark.read.csv(path, header=True) if path.lower().rstrip("/").endswith(".csv") else spark.read.parquet(path)
    return df.select(*(f"`{c}`" for c in dict.fromkeys(columns) if c in df.columns))


def symbols_file(spark: SparkSession, path: str) -> DataFrame:
    """symbol of each line; blank lines and lines that begin with # are left out."""
    return spark.read.text(path).select(F.trim("value").alias("symbol")).filter("symbol <> '' and not startswith(symbol, '#')")


def universe_by_date(df: DataFrame) -> DataFrame:
    """Distinct (trade_date, symbol) of the selected rows; unreadable dates and empty symbols are left out."""
    date, symbol, selected = present(df, UNIVERSE_DATES), present(df, UNIVERSE_SYMBOLS), present(df, UNIVERSE_SELECTED, needed=False)
    rows = df.filter(truthy(f"`{selected}`")) if selected else df
    made = rows.select(parse_date(f"`{date}`").alias("trade_date"), F.trim(F.col(f"`{symbol}`").cast("string")).alias("symbol"))
    return made.filter("trade_date is not null and symbol <> ''").distinct()


def return_series(df: DataFrame, order: str, values: Sequence[str] = RETURN_VALUES, dates: Sequence[str] = RETURN_DATES, name: str = "benchmark_return") -> DataFrame:
    """trade_date and the number of each date's last row by `order`; rows without a date or a number do not count."""
    date, value = present(df, dates), present(df, values)
    made = df.select(parse_date(f"`{date}`").alias("trade_date"), F.col(f"`{value}`").cast("string").try_cast("double").alias(name), F.col(order).alias("_order"))
    return keep_last(made.filter(F.col("trade_date").isNotNull() & F.col(name).isNotNull() & ~F.isnan(name)), ["trade_date"], ["_order"]).drop("_order")


SCORES = ("signal_eval", "signal", "pred", "score")
SCORE_DATES = ("trade_date", "date", "rebalance_date")


def scored_panel(df: DataFrame, features: Sequence[str] = ()) -> DataFrame:
    """trade_date, symbol, score and those of the features that are there, as numbers, of a table of scored rows.

    Headers may vary; symbols are trimmed. Rows without a readable date, a symbol or a finite score are left out. A table may carry its
    keys as columns of any of the accepted names; repeated keys stay.
    """
    date, symbol, score = present(df, SCORE_DATES), present(df, UNIVERSE_SYMBOLS), present(df, SCORES)
    number = lambda c: F.col(f"`{c}`").cast("string").try_cast("double")
    made = df.select(parse_date(f"`{date}`").alias("trade_date"), F.trim(F.col(f"`{symbol}`").cast("string")).alias("symbol"), number(score).alias("score"), *(number(c).alias(c) for c in features if c in df.columns and c != score))
    ok = F.col("trade_date").isNotNull() & (F.col("symbol") != "") & F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    return made.filter(ok)


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """df with the named columns as given types (a text that is no such value becomes null), dates in either form; others stay as they are."""
    cast = {c: parse_date(f"`{c}`") if kind == "date" else F.col(f"`{c}`").try_cast(kind) for c, kind in kinds.items() if c in df.columns}
    return df.withColumns(cast)


# Accepted headers of instruments, labels and prices.
SYMBOLS = ("symbol", "ts_code", "order_book_id", "stock_ticker")
LISTED = ("list_date", "listed_date")
PRICE_DATES = ("trade_date", "date", "datetime")


def instruments(df: DataFrame) -> DataFrame:
    """symbol, name, list_date of a reference table; name or list_date may be absent (null). One row for each symbol, the last by list_date."""
    symbol, listed, name = present(df, SYMBOLS), present(df, LISTED, needed=False), present(df, ("name", "display_name"), needed=False)
    date = parse_date(f"`{listed}`") if listed else F.lit(None).cast("date")
    made = df.select(F.trim(F.col(f"`{symbol}`").cast("string")).alias("symbol"), (F.col(f"`{name}`").cast("string") if name else F.lit(None).cast("string")).alias("name"), date.alias("list_date"))
    best = made.filter("symbol <> ''").groupBy("symbol").agg(F.max_by(F.struct("name", "list_date"), F.struct("list_date", "name")).alias("x"))
    return best.select("symbol", "x.name", "x.list_date")


def keyed(df: DataFrame, values: Sequence[str], dates: Sequence[str] = PRICE_DATES, symbols: Sequence[str] = SYMBOLS, order: str | None = None) -> DataFrame:
    """trade_date, symbol and the values of a table with varying key headers; rows without a key are left out.

    A repeated key keeps its last row by `order`; without an order equal keys keep the one of largest values.
    """
    date, symbol = present(df, dates), present(df, symbols)
    missing = [v for v in values if v not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    made = df.select(parse_date(f"`{date}`").alias("trade_date"), F.trim(F.col(f"`{symbol}`").cast("string")).alias("symbol"), F.struct(*(f"`{v}`" for v in values)).alias("_v"), (F.col(order) if order else F.lit(0)).alias("_o"))
    best = made.filter("trade_date is not null and symbol <> ''").groupBy("trade_date", "symbol").agg(F.max_by("_v", F.struct("_o", "_v")).alias("_v"))
    return best.select("trade_date", "symbol", "_v.*")


def many(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The columns of several Parquet paths as one table; a column that a path lacks is null there, one that all lack fails."""
    df = spark.read.option("mergeSchema", True).parquet(*paths)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*(f"`{c}`" for c in columns))


# The columns a table of disclosed details must have.
PROBE = ("symbol", "order_book_id", "field", "quarter", "fiscal_year", "relationship", "currency", "standard", "subject", "amount", "info_date", "if_adjusted")


def details(df: DataFrame, fields: Sequence[str] = ()) -> DataFrame:
    """Disclosed details: required columns checked, texts trimmed, field, quarter and standard lower case, dates and numbers read, keys complete."""
    missing = [c for c in PROBE if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    text = lambda c: F.trim(F.col(c).cast("string"))
    low = {c: F.lower(text(c)).alias(c) for c in ("field", "quarter", "standard")}
    read = {"amount": F.col("amount").cast("string").try_cast("double").alias("amount"), "info_date": parse_date("info_date").alias("info_date"), "fiscal_year": parse_date("fiscal_year").alias("fiscal_year")}
    made = df.select(*((low | read).get(c, text(c).alias(c)) for c in PROBE))
    made = made.filter("symbol <> '' and field <> '' and quarter <> '' and subject <> ''")
    return made.filter(F.col("field").isin(*map(str.lower, fields))) if fields else made


def write_tables(named: dict[str, DataFrame], path: str) -> list[str]:
    """One Parquet folder for each table; the names of those that have rows, told by what was written, so no plan runs twice."""
    kept = []
    for n, df in named.items():
        at = f"{path.rstrip('/')}/{n}"
        df.write.mode("overwrite").parquet(at)
        if df.sparkSession.read.schema(df.schema).parquet(at).head(1):
            kept.append(n)
    return kept


def position_tables(positions: DataFrame) -> dict[str, DataFrame]:
    """by_rebalance, current (the latest entry) and diff of the last two entries (symbol, old_value, new_value, status)."""
    from ..operators.joins import diff
    from ..operators.portfolio import holdings_at

    days = positions.select("entry_date").distinct().orderBy(F.desc("entry_date")).limit(2).withColumn("_n", F.row_number().over(Window.orderBy(F.desc("entry_date"))))  # two rows
    two = positions.join(F.broadcast(days), "entry_date")
    now, before = two.filter("_n = 1").drop("_n"), two.filter("_n = 2").drop("_n")
    return {"by_rebalance": positions, "current": holdings_at(positions, "9999-12-31"), "diff": diff(now, before, ["symbol"], "weight")}


def periods(frames: Sequence[DataFrame]) -> DataFrame:
    """Distinct (rebalance_date, entry_date, exit_date) of several tables, complete rows only."""
    made = (f.select(*(parse_date(c).alias(c) for c in PERIOD)).dropna() for f in frames)
    return reduce(DataFrame.unionByName, made).distinct()


def write_by_year(df: DataFrame, path: str, date: str = "trade_date") -> None:
    """Parquet in one folder for each year; rows of a year may come from many tasks."""
    df.withColumn("trade_year", F.year(date)).write.mode("overwrite").partitionBy("trade_year").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, in as many files as the table has partitions; the committer makes it appear whole."""
    df.write.mode("overwrite").option("header", True).csv(path)
