"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

from importlib import import_module

MODULES = ("market", "ranking", "quality", "texts", "pages", "matching", "storage")


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        for key, value in getattr(import_module(f"offerscope.plans.{name}"), attribute).items():
            if key in out:
                raise ValueError(f"query {key} registered twice")
            out[key] = value
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE")
