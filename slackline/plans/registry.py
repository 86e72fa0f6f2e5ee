"""All registered queries of the schedule engine."""

from __future__ import annotations

from importlib import import_module

MODULES = ("core_queries", "more_queries", "extra_queries", "final_queries", "portfolio_queries", "register_queries")


def _modules():
    return [import_module(f"slackline.plans.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.SQL.items()}
