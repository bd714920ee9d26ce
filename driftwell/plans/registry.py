"""Named queries over the given tables, each with the SQL that defines its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load_all() -> None:
    """Import the modules that register queries."""
    from driftwell.plans import (  # noqa: F401
        checks_availability,
        checks_experiment,
        checks_jobs,
        checks_live,
        checks_metrics,
        checks_prepare,
        checks_scoring,
        checks_selection,
        checks_sources,
    )
