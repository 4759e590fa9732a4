"""Imports every query module and returns the filled registry."""

from __future__ import annotations

from importlib import import_module

from scorewright.plans.registry import ORACLE, QUERIES, Query

MODULES = ["queries_data", "queries_rules", "queries_models", "queries_flows"]


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for m in MODULES:
        import_module(f"scorewright.plans.{m}")
    return QUERIES, ORACLE
