"""Registered queries and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name; ``sql`` is None where SQL cannot express it."""

    def add(made: Callable) -> Callable:
        QUERIES[made.__name__] = made
        if sql:
            ORACLE[made.__name__] = sql
        return made

    return add


def load() -> None:
    """Import the modules whose queries are registered."""
    from stemmata.plans import coordinates, evidence, library, lookups, statistics, text_reuse  # noqa: F401
