"""Registry of named queries and their ANSI-SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom import lexicon as lx
from docloom.plans.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_TWINS: dict[str, tuple[tuple[str, ...], str]] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def query(name: str, oracle: str | None = None, ctes: tuple[str, ...] = ()):
    """Register ``fn(tables) -> DataFrame``; ``oracle`` is the body of the twin."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            _TWINS[name] = (ctes, oracle)
        return fn

    return register


def oracles() -> dict[str, str]:
    return {name: with_ctes(ctes, body) for name, (ctes, body) in _TWINS.items()}


def cte(name: str, text: str, deps: tuple[str, ...] = ()) -> None:
    CTES[name] = (deps, text)


def with_ctes(names: tuple[str, ...], body: str) -> str:
    ordered: list[str] = []

    def visit(n: str) -> None:
        for dep in CTES[n][0]:
            visit(dep)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        visit(n)
    if not ordered:
        return body
    clauses = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered)
    return f"WITH RECURSIVE {clauses}\n{body}"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def sql_strip(expr: str) -> str:
    return f"trim({expr}, {quote(lx.WHITESPACE)})"
