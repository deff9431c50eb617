"""Registered queries over the given tables, each with the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("vector", "keyword", "fusion", "search", "citations", "feed", "operations", "library", "rules", "snippets")


class Registry:
    """Queries and their SQL, by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(fn: Callable[[SparkSession, str], DataFrame]):
            self.queries[fn.__name__] = fn
            if sql:
                self.sql[fn.__name__] = sql
            return fn

        return add


def _all() -> list[Registry]:
    return [import_module(f"{__name__}.{m}").register for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for r in _all() for k, v in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for r in _all() for k, v in r.sql.items()}
