"""Queries by name: a function of the fixtures, and its SQL twin made of common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: name: (names it needs, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, needs: str, sql: str) -> None:
    VIEWS[name] = tuple(needs.split()), sql


def with_views(needs: str, body: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for n in VIEWS[name][0]:
                add(n)
            order.append(name)

    for n in needs.split():
        add(n)
    return f"WITH RECURSIVE {', '.join(f'{n} AS ({VIEWS[n][1]})' for n in order)} {body}" if order else body


def query(name: str, needs: str = "", sql: str | None = None):
    """Registers a function of Fixtures; without sql the query has no twin."""

    def register(f: Callable[[Fixtures], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_views(needs, sql)
        return f

    return register
