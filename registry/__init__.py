"""Registered queries over the given tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

from importlib import import_module

GROUPS = ["cleaning", "features", "metrics", "drifting", "checks", "alerts", "models", "streams"]


def load():
    """All queries and all SQL texts, by name."""
    for group in GROUPS:
        import_module(f"registry.{group}")
    from registry.common import ORACLES, QUERIES

    return QUERIES, ORACLES
