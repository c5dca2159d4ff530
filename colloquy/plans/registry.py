"""How a module of queries names them and their SQL."""

from __future__ import annotations


def registry():
    """Queries by name, their SQL by name, and the decorator that puts a function into both."""
    queries: dict = {}
    oracle: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return queries, oracle, query
