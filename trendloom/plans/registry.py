"""Where queries register, and the SQL names of the shared views."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# name -> (names it builds on, SQL text)
VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, text: str, *needs: str) -> None:
    VIEWS[name] = (list(needs), text)


def with_views(names: list[str], query: str, recursive: bool = False) -> str:
    """``query`` preceded by the views it names and those they build on."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for need in VIEWS[name][0]:
                add(need)
            order.append(name)

    for name in names:
        add(name)
    if not order:
        return query
    head = "WITH RECURSIVE " if recursive else "WITH "
    parts = [f"{name} AS MATERIALIZED (\n{VIEWS[name][1].strip()}\n)" for name in order]
    return head + ",\n".join(parts) + "\n" + query.strip()


def query(
    sql: str | None = None, views: str = "", recursive: bool = False
) -> Callable[[Callable], Callable]:
    """Register the decorated function under its own name.

    ``views`` names the shared views the SQL text uses, separated by spaces.
    """

    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        name = build.__name__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = with_views(views.split(), inspect.cleandoc(sql), recursive)
        return build

    return register
