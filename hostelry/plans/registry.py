"""Names of the engine's own queries, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name, with its SQL where there is one."""

    def add(function: Callable) -> Callable:
        if function.__name__ in QUERIES:
            raise ValueError(f"two queries are named {function.__name__}")
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def load() -> None:
    """Import the modules that register queries."""
    from hostelry.plans import analysis, costs, decisions, distribution, expected, fields, imports, labor, quality, records, removals, sheets, snapshots, structured  # noqa: F401


load()
