"""Registry of queries by operator id, each with its oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its operator id."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r6(column: Column | str) -> Column:
    """Round to six places, the precision both engines are compared at."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def load() -> None:
    """Import the modules that register queries."""
    from endsight.plans import (  # noqa: F401
        catalog_annotation,
        catalog_compare,
        catalog_features,
        catalog_more,
        catalog_outputs,
        catalog_sites,
        catalog_transcripts,
    )
