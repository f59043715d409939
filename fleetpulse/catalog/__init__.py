"""Registered queries: key -> Spark callable ``(spark, sf_dir) -> DataFrame`` and
key -> oracle SQL (DuckDB) for the correctness gate.

Keys follow the operator inventory. Importing this package imports every
module that registers queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SQL: dict[str, str] = {}  # oracle SQL before the derived-table prefix is added


def register(key: str, sql: str | None = None):
    """Decorator registering a query under ``key`` with its oracle SQL (if any)."""

    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate key {key}")
        QUERIES[key] = fn
        if sql is not None:
            from fleetpulse.checks.oracle import with_derived

            SQL[key] = sql
            ORACLE[key] = with_derived(sql)
        return fn

    return deco


def load_all() -> None:
    from fleetpulse.catalog import scoring  # noqa: F401
    from fleetpulse.catalog import relational  # noqa: F401
    from fleetpulse.catalog import api  # noqa: F401
    from fleetpulse.catalog import packs  # noqa: F401
    from fleetpulse.catalog import ingest  # noqa: F401
    from fleetpulse.catalog import benchops  # noqa: F401
    from fleetpulse.catalog import extras  # noqa: F401
    from fleetpulse.catalog import streams  # noqa: F401
