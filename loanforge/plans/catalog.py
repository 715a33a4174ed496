"""All registered queries, one module per area of the engine."""

from __future__ import annotations

from importlib import import_module

from loanforge.plans.registry import Query

AREAS = [
    "evaluation_queries",
    "data_queries",
    "prep_queries",
    "feature_queries",
    "risk_queries",
    "governance_queries",
    "model_queries",
]


def _registries():
    return [import_module(f"loanforge.plans.{a}").REG for a in AREAS]


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for r in _registries():
        for k, v in r.queries.items():
            if k in out:
                raise ValueError(f"query {k!r} registered twice")
            out[k] = v
    return out


def all_sql() -> dict[str, str]:
    return {k: v for r in _registries() for k, v in r.sql.items()}
