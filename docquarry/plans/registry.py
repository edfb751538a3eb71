"""How plan modules register queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docquarry.tables import table


def registry() -> tuple[Callable, dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """A decorator for functions of the tables they name, and the queries and SQL it fills."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None):
        def add(f):
            names = f.__code__.co_varnames[: f.__code__.co_argcount]

            def run(spark: SparkSession, d: str) -> DataFrame:
                return f(*[table(spark, d, n) for n in names])

            queries[f.__name__] = run
            if text is not None:
                sql[f.__name__] = text
            return f

        return add

    return query, queries, sql


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_labels(text: str, rules: list[tuple[str, str]]) -> str:
    """SQL list of the labels whose pattern is found in ``text``, in rule order."""
    return "list_filter([" + ", ".join(f"case when regexp_matches({text}, {sql_text(p)}) then {sql_text(name)} end" for name, p in rules) + "], lambda x: x is not null)"
