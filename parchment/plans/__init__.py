"""Registered queries: a Spark callable and, where SQL can express it, the DuckDB oracle."""

from __future__ import annotations

from importlib import import_module

from parchment.plans.registry import ORACLES, QUERIES

MODULES = ("text_queries", "search_queries", "keyword_queries", "service_queries", "selection_queries", "state_queries", "view_queries")


def load() -> tuple[dict, dict]:
    """(queries, oracles) of the whole package."""
    for name in MODULES:
        import_module(f"parchment.plans.{name}")
    return dict(QUERIES), dict(ORACLES)
