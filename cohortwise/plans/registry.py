"""Registry that keeps each query next to its independent SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortwise.plans.views import VIEWS, view_closure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query; ``views`` names the shared views its SQL check needs."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return fn

    return register


def with_views(sql: str, views: str) -> str:
    names = view_closure(views.split())
    ctes = [f"{n} AS ({VIEWS[n]})" for n in names]
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes) + ", " + body[5:]
    return "WITH " + ", ".join(ctes) + " " + body


def r(expr: str, digits: int = 6) -> str:
    """SQL twin of ``functions.numeric.rounded``."""
    return f"CASE WHEN abs({expr}) < {0.5 * 10.0 ** -digits!r} THEN 0e0 ELSE round(CAST({expr} AS DOUBLE), {digits}) END"
