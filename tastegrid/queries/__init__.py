"""Registered queries over the domain tables, each with its SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tastegrid.sources.domain import BASE_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MODULES = ("vectors", "scoring", "tastes", "discovery", "identity", "episodes", "text", "ranking", "catalogs", "heroes", "streams", "more", "configs", "details", "providers", "searches", "matching")


def with_tables(sql: str, tables: tuple[str, ...]) -> str:
    """sql with the common table expressions of the domain tables it names."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in BASE_SQL[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for t in tables:
        need(t)
    own = sql.strip()
    heads = [f"{t} AS ({BASE_SQL[t][1].strip()})" for t in order]
    if own[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join([*heads, own[15:]])
    if own[:5].upper() == "WITH ":
        return "WITH " + ",\n".join([*heads, own[5:]])
    return ("WITH " + ",\n".join(heads) + "\n" if heads else "") + own


def query(name: str, sql: str | None = None, tables: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_tables(sql, tables)
        return f

    return add


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"tastegrid.queries.{m}")
