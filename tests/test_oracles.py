"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

DATA = os.environ.get("XPANEL_TEST_DIR", "/root/testdata/sf0.001")
NAMES = ("ridge_predictions", "walk_forward_report", "cv_ic", "linear_sweep", "cpcv_purged", "cpcv_refit_metrics", "execution_orders", "execution_summary", "secondary_fill", "ema", "macd_hist", "capped_buffered_holdings", "turnover_buffered", "buffered_backtest", "construction_grid", "ic_summary", "metric_snapshot", "liquidity_buckets", "rolling_max_drawdown", "open_to_close_backtest", "live_snapshot", "neutral_scores", "daily_ic_spearman", "quantile_returns", "asof_merge", "universe_asof", "topk_backtest", "label_next_rebalance", "event_overlap_purge", "ffill_limit", "sell_fills", "contribution_summary", "drawdown_episodes", "rolling_beta", "universe_headers", "return_headers", "round_lot_pick", "latest_price", "sell_signals", "scenario_grid", "target_export", "order_summary", "return_summary", "drawdown_timing", "long_short_backtest", "buffered_holdings", "parameter_grid", "modeling_dataset", "label_shifted_rebalance", "style_exposures", "period_benchmark", "cpcv_path_metrics", "rsi", "neutralize_many", "factor_ic_report", "benchmark_ladder", "run_ranking", "promotion_gate", "period_plan_horizon")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, sql, name):
    from xpanel import queries

    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rel = sql.sql(queries.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=str)
    assert len(got) == len(want)
    assert [w for g, w in zip(got, want) if any(a != b and not (isinstance(a, float) and abs(a - b) < 2e-5) for a, b in zip(g, w))] == []


def test_entry_imports_without_a_session():
    import __spark_entry__

    assert "daily_ic_spearman" in __spark_entry__.queries()
