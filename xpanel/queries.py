"""Every registered query of the panel engine with its SQL oracle."""

from __future__ import annotations

from .plans import live_queries, model_queries, panel_queries, portfolio_queries, research_queries, signal_queries  # noqa: F401  they register themselves
from .plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
