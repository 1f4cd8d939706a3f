"""Every registered query of the market-panel library with its SQL."""

from __future__ import annotations

from tessera.plans import q_ablation, q_backtest, q_clean, q_crossfit, q_evaluate, q_gates, q_gridrun, q_joins, q_models, q_more, q_news, q_rules, q_series, q_sources, q_stacking, q_stategates, q_stats, q_stream, q_xsec  # noqa: F401
from tessera.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
