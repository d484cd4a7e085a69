"""Where the plan modules enter their queries."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Enters a function of (spark, sf_dir) under a name, with the SQL that says the same."""

    def enter(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return enter
