"""How queries and their SQL are kept by name."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    """(queries, SQL, decorator): the decorator keeps a function of (spark, folder) under a name, with its SQL if it has one."""
    queries: dict = {}
    sql: dict = {}

    def query(name: str, text: str | None = None):
        def keep(f):
            queries[name] = f
            if text:
                sql[name] = text
            return f

        return keep

    return queries, sql, query
