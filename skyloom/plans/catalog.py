"""Registry of the engine's queries: each name maps to a plan builder and, where SQL can express it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import library_queries, orbit_queries, run_queries, sky_queries, space_queries  # noqa: F401  (registering)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    """Query builders by name."""
    return dict(sky_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return dict(sky_queries.ORACLES)
