"""Collects a module's queries with their SQL."""

from __future__ import annotations


def catalog():
    """(queries, sql, decorator): the decorator files a function under its name, with the SQL it must equal."""
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None):
        def file(f):
            queries[f.__name__] = f
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return file

    return queries, oracles, query
