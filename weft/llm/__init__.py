"""Operators for training data, one module per problem of TESTDATA.md. Nothing outside this package imports it."""

from __future__ import annotations

from importlib import import_module

MODULES = ["near_copies", "groups", "overlaps", "defects", "top_n", "links", "tokens", "mixing", "abuse"]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"{__name__}.{m}").SQL.items()}
