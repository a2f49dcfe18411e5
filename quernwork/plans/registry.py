"""The queries of the engine and their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["pay_plan", "text_plan", "store_plan", "flow_plan"]


def queries() -> dict:
    out = {}
    for m in _MODULES:
        out |= import_module(f"quernwork.plans.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out |= getattr(import_module(f"quernwork.plans.{m}"), "SQL", {})
    return out
