"""The named queries of the engine's operators, gathered from the modules that define them."""

from __future__ import annotations

from siltstone.plans import evaluation, ingest, routing, search, storage

REGISTRIES = [m.R for m in (ingest, search, evaluation, routing, storage)]


def queries() -> dict:
    return {name: q for r in REGISTRIES for name, q in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for r in REGISTRIES for name, sql in r.sql.items()}
