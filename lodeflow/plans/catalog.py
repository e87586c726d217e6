"""All registered queries of the core, with the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("documents", "findings", "corpus", "business", "taint")


def _merged(name: str) -> dict:
    merged: dict = {}
    for module in _MODULES:
        merged |= getattr(import_module(f"lodeflow.plans.{module}"), name)
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE")
