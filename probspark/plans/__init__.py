"""Queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

from probspark.plans.registry import ORACLE_SQL, QUERIES

for _name in ("panel_queries", "turning_queries", "lowbuy_queries", "fusion_queries", "history_queries", "load_queries", "graph_queries", "analysis_queries", "report_queries", "sequential_queries"):
    import_module(f"probspark.plans.{_name}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE_SQL)
