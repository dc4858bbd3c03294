"""Registry of runnable queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runloom.catalog.views import SQL_VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(body: str) -> str:
    """Prefix a query with the views it names, and the views those name."""
    wanted: list[str] = []

    def visit(text: str) -> None:
        for name, sql in SQL_VIEWS.items():
            if name in text and name not in wanted:
                visit(sql)
                if name not in wanted:
                    wanted.append(name)

    visit(body)
    if not wanted:
        return body
    views = ",\n".join(f"{name} AS ({SQL_VIEWS[name]})" for name in wanted)
    if body.lstrip().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views},\n" + body.lstrip()[len("WITH RECURSIVE"):]
    if body.lstrip().startswith("WITH"):
        return f"WITH {views},\n" + body.lstrip()[len("WITH"):]
    return f"WITH {views}\n{body}"


def query(key: str, sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` under ``key``, with its SQL equivalent."""

    def add(build: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = with_views(sql)
        return build

    return add
