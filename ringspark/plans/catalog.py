"""All queries of the engine itself, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from ringspark.plans import more_queries, repair_queries, ring_queries, state_queries, store_queries, view_queries

MODULES = (ring_queries, store_queries, repair_queries, view_queries, more_queries, state_queries)


def queries() -> dict[str, Callable]:
    return {name: f for m in MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
