"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["survivor", "linkage", "places", "truncation", "increment", "leakage", "mixing", "sentences"]


def queries() -> dict:
    out = {}
    for m in _MODULES:
        out |= import_module(f"quernwork.llm.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out |= getattr(import_module(f"quernwork.llm.{m}"), "SQL", {})
    return out
