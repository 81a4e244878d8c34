"""All registered queries of the library, without those of subpackages that may be absent."""

from __future__ import annotations

from importlib import import_module

MODULES: list[str] = ["retrieval", "evaluation", "corpus", "resolution", "graph"]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"weft.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"weft.plans.{m}").SQL.items()}
