"""The stored lake: tables as Parquet folders under ``root/<namespace>/<table>``.

Reads always supply the declared schema (partition columns keep SMALLINT /
TINYINT types; no inference), and expose the same table attributes as
``DerivedLake``, so every plan runs unchanged on stored data, where the
``year/month/day`` predicates added beside time bounds prune folders and the
``collected_at`` / ``instance_id`` predicates reach Parquet statistics.
"""

from __future__ import annotations

import contextlib
import os

from pyspark.sql import DataFrame, SparkSession

from fleetpulse import schemas as S

SCORING_TABLES = (
    "instances", "databases", "pings", "metric_cpu", "metric_memory", "metric_sessions",
    "metric_database_io", "metric_blocking", "score_thresholds",
)


def _namespace(table: str) -> str:
    for ns, t in S.TABLES:
        if t == table:
            return ns
    raise KeyError(table)


def table_path(root: str, table: str) -> str:
    return os.path.join(root, _namespace(table), table)


class Lake:
    """Stored lake tables, read lazily with their declared schemas."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def table(self, name: str) -> DataFrame:
        cache = self.__dict__.setdefault("_tables", {})
        if name not in cache:
            schema = S.schema_of(name, _namespace(name))
            cache[name] = self.spark.read.schema(schema).parquet(table_path(self.root, name))
        return cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            _namespace(name)
        except KeyError:
            raise AttributeError(name) from None
        return self.table(name)


def materialize(source, root: str, tables=SCORING_TABLES) -> Lake:
    """Write ``tables`` of ``source`` (e.g. a ``DerivedLake``) as the stored lake at ``root``.

    Facts are appended partitioned by their DDL layout; dimensions are written
    unpartitioned. Returns a ``Lake`` over ``root``.
    """
    from fleetpulse.plans.ingest import partitioned_append

    for name in tables:
        ns = _namespace(name)
        partitions = S.TABLES[(ns, name)][1]
        partitioned_append(getattr(source, name), table_path(root, name), partitions)
    return Lake(source.spark, root)


@contextlib.contextmanager
def catalog_tables(lake: Lake, names):
    """Stored tables under their namespaces (``common.pings``) in the session's catalog, for SQL text analysed inside.

    They are external tables with the declared schemas, whose folders are listed when a query is analysed and pruned by its
    predicates. Only tables that were not there before are made, and these are dropped afterwards (files stay; a plan that was
    analysed keeps its tables).
    """
    spark, made = lake.spark, []
    tracked = "spark.sql.hive.manageFilesourcePartitions"  # else a plan asks the catalog for partitions when it runs
    old = spark.conf.get(tracked)
    spark.conf.set(tracked, "false")
    for ns in {_namespace(n) for n in names}:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {ns} LOCATION '{os.path.join(lake.root, '_catalog', ns)}'")
    try:
        for n in names:
            ns, path = _namespace(n), table_path(lake.root, n)
            if spark.catalog.tableExists(f"{ns}.{n}"):
                raise ValueError(f"{ns}.{n} is a table of this session already")
            partitions = S.TABLES[(ns, n)][1]
            fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.schema_of(n, ns).fields)
            by = f"PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
            spark.sql(f"CREATE TABLE {ns}.{n} ({fields}) USING parquet {by} LOCATION '{path}'")
            made.append(f"{ns}.{n}")
        yield
    finally:
        spark.conf.set(tracked, old)
        for name in made:
            spark.sql(f"DROP TABLE {name}")
