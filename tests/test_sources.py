"""Readers and checks on small tables with odd headers, nulls and repeated rows."""

import datetime as dt

import pytest

from xpanel.operators import live
from xpanel.sources import tables


def test_periods_and_files(spark, tmp_path):
    rows = [("20200131", "2020-02-03", "20200228"), ("20200131", "2020-02-03", "20200228"), (None, "20200301", "20200331"), ("odd", "20200301", "20200331")]
    frame = spark.createDataFrame(rows, "rebalance_date string, entry_date string, exit_date string")
    made = tables.periods([frame, frame])
    assert [tuple(r) for r in made.collect()] == [(dt.date(2020, 1, 31), dt.date(2020, 2, 3), dt.date(2020, 2, 28))]
    tables.write_csv(frame, f"{tmp_path}/p.csv")
    assert tables.projected(spark, f"{tmp_path}/p.csv", ["exit_date", "absent"]).columns == ["exit_date"]
    tables.write_by_year(made, f"{tmp_path}/years", "entry_date")
    assert spark.read.parquet(f"{tmp_path}/years").filter("trade_year = 2020").count() == 1
    (tmp_path / "symbols.txt").write_text("# names\n AAA \n\nBBB\n")
    assert sorted(r[0] for r in tables.symbols_file(spark, f"{tmp_path}/symbols.txt").collect()) == ["AAA", "BBB"]


def test_missing_headers_fail(spark):
    with pytest.raises(ValueError):
        tables.universe_by_date(spark.createDataFrame([("a",)], "other string"))


@pytest.mark.parametrize("rows", [[("A", 0.5, "short")], [("A", None, "long")], [("A", -0.1, "long")], [("A", 0.6, "long"), ("B", 0.6, "long")], [("A", 0.2, "long"), ("A", 0.2, "long")], [("A", float("nan"), "long")]])
def test_targets_that_are_not_valid_fail(spark, rows):
    held = spark.createDataFrame(rows, "symbol string, weight double, side string")
    with pytest.raises(Exception, match="not valid targets"):
        live.targets(held).collect()


def test_round_lots_prefer_the_mode_then_the_last(spark):
    df = spark.createDataFrame([("A", 100.0, 1), ("A", 200.0, 2), ("A", 100.0, 3), ("B", 5.0, 1), ("B", 7.0, 2), ("C", None, 1)], "symbol string, lot double, at int")
    assert sorted(map(tuple, live.round_lots(df, "symbol", "lot", "at").collect())) == [("A", 100.0), ("B", 7.0)]


def test_no_orders(spark):
    none = spark.createDataFrame([], "side string, status string, requested_notional double, filled_notional double, unfilled_notional double")
    row = live.order_summary(none).first()
    assert row.orders == 0 and row.requested_notional == 0 and row.fill_ratio is None


def test_scored_panels_and_typed_columns(spark, tmp_path):
    from xpanel.sources import tables

    raw = spark.createDataFrame([("20200102", " A ", "1.5", "x"), ("2020-01-03", "B", "nan", "2"), ("bad", "C", "1", "2"), ("20200103", " ", "1", "2"), ("20200103", "D", "inf", "2"), ("20200103", "E", "-2", None)], "date string, ts_code string, Signal string, f string")
    got = sorted((str(r.trade_date), r.symbol, r.score, r.f) for r in tables.scored_panel(raw, ["f"]).collect())
    assert got == [("2020-01-02", "A", 1.5, None), ("2020-01-03", "E", -2.0, None)]
    raw.write.option("header", True).csv(str(tmp_path / "x.csv"))
    made = tables.typed(tables.projected(spark, str(tmp_path / "x.csv"), ["date", "f", "none"]), {"date": "date", "f": "int", "none": "int"})
    assert made.dtypes == [("date", "date"), ("f", "int")] and sorted(str(r.date) for r in made.filter("f = 2").collect()) == ["2020-01-03"] * 3 + ["None"]
