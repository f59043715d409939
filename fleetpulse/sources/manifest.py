"""The collection manifest: which collectors exist and their column contracts.

Each collector's contract is the ordered column list of its target table, each
column sourced as ``stamp`` (filled by the cycle: instance_id, platform,
collected_at, year, month, day), ``query`` (from the landed result by name) or
``const`` (literal NULL). The contract is built from the table schemas, so the
two cannot drift.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse import schemas as S

STAMP_COLUMNS = ("instance_id", "platform", "collected_at", "year", "month", "day")

# Collector -> (target table, level, cadence, timeout seconds, enabled, const columns).
COLLECTORS = (
    ("metric_cpu", "common.metric_cpu", "instance", "5m", 5, None, ()),
    ("metric_memory_ple", "common.metric_memory", "instance", "5m", 5, None,
     ("buffer_hit_ratio", "grants_pending", "grants_outstanding")),
    ("metric_sessions", "common.metric_sessions", "instance", "5m", 5, None, ()),
    ("metric_database_io", "common.metric_database_io", "database", "15m", 30, None, ()),
    ("metric_blocking", "common.metric_blocking", "database", "5m", 5, None, ()),
    ("databases", "common.databases", "database", "hourly", 10, None, ()),
    ("instance_details", "common.instance_details", "instance", "15m", 10, None, ()),
    ("ha_databases", "sqlserver.ha_databases", "database", "5m", 5, None, ()),
    ("metric_wait_stats", "common.metric_wait_stats", "instance", "5m", 5, True, ()),
    ("metric_perf_counters", "common.metric_perf_counters", "instance", "5m", 5, True, ()),
    ("config_settings", "sqlserver.config_settings", "instance", "hourly", 10, True, ()),
    ("trace_flags", "sqlserver.trace_flags", "instance", "hourly", 10, True, ()),
    ("backup_status", "sqlserver.backup_status", "database", "hourly", 30, True, ()),
    ("integrity_status", "sqlserver.integrity_status", "database", "hourly", 15, True, ()),
    ("ha_cluster_members", "sqlserver.ha_cluster_members", "instance", "5m", 5, True, ()),
    ("ha_availability_replicas", "sqlserver.ha_availability_replicas", "instance", "5m", 5, True, ()),
    ("mirroring_health", "sqlserver.mirroring_health", "database", "5m", 5, True, ()),
)
COLLECTOR_NAMES = tuple(c[0] for c in COLLECTORS)


def contract(name: str) -> list[tuple[str, T.DataType, str]]:
    """Ordered ``(column, type, source)`` for one collector."""
    row = next(c for c in COLLECTORS if c[0] == name)
    ns, table = row[1].split(".")
    schema = S.schema_of(table, ns)
    consts = set(row[6])
    out = []
    for f in schema.fields:
        if f.name in consts:
            src = "const"
        elif f.name in STAMP_COLUMNS:
            src = "stamp"
        else:
            src = "query"
        out.append((f.name, f.dataType, src))
    return out


def target_schema(name: str) -> T.StructType:
    row = next(c for c in COLLECTORS if c[0] == name)
    ns, table = row[1].split(".")
    return S.schema_of(table, ns)


def query_columns(name: str) -> list[tuple[str, T.DataType]]:
    return [(c, t) for c, t, s in contract(name) if s == "query"]


def manifest_json() -> dict:
    """The manifest as a nested JSON document (collectors[] -> schema[])."""
    cols = []
    for name, target, level, cadence, timeout, enabled, _ in COLLECTORS:
        entry = {
            "name": name, "target_table": target, "level": level, "cadence": cadence,
            "timeout_seconds": timeout, "query": f"{name}.sql",
            "schema": [{"name": c, "type": t.simpleString().upper(), "source": s} for c, t, s in contract(name)],
        }
        if enabled is not None:
            entry["enabled"] = enabled
        cols.append(entry)
    return {"platform": "sqlserver", "collectors": cols}


def write_manifest(path: str) -> str:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        json.dump(manifest_json(), fh, indent=1)
    return path


MANIFEST_SCHEMA = T.StructType([
    T.StructField("platform", T.StringType()),
    T.StructField("collectors", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("target_table", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("cadence", T.StringType()),
        T.StructField("timeout_seconds", T.IntegerType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("query", T.StringType()),
        T.StructField("schema", T.ArrayType(T.StructType([
            T.StructField("name", T.StringType()),
            T.StructField("type", T.StringType()),
            T.StructField("source", T.StringType()),
        ]))),
    ]))),
])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Read the nested manifest and flatten to one row per (collector, column)."""
    doc = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)
    c = doc.select(F.posexplode("collectors").alias("collector_pos", "c"))
    return c.select(
        "collector_pos", F.col("c.name").alias("collector_name"), F.col("c.target_table").alias("target_table"),
        F.col("c.level").alias("level"), F.col("c.cadence").alias("cadence"),
        F.col("c.timeout_seconds").alias("timeout_seconds"),
        F.coalesce(F.col("c.enabled"), F.lit(True)).alias("enabled"),
        F.posexplode("c.schema").alias("column_pos", "s"),
    ).select("collector_pos", "collector_name", "target_table", "level", "cadence", "timeout_seconds", "enabled",
             "column_pos", F.col("s.name").alias("column_name"), F.col("s.type").alias("column_type"),
             F.col("s.source").alias("source"))


def select_collectors(collectors: DataFrame, names=None, cadence: str | None = None) -> DataFrame:
    """Enabled collectors, then explicit names, else one cadence tier.

    ``collectors`` has one row per collector (``collector_name``, ``cadence``,
    ``enabled``). Raises when the selection is empty (checked on the small
    manifest only).
    """
    sel = collectors.filter(F.coalesce(F.col("enabled"), F.lit(True)))
    if names:
        sel = sel.filter(F.col("collector_name").isin(*names))
    elif cadence:
        sel = sel.filter(F.col("cadence") == cadence)
    if sel.limit(1).count() == 0:
        raise ValueError("no collector selected")
    return sel


def collectors_df(spark: SparkSession) -> DataFrame:
    rows = [(n, t, lv, cad, to, en) for n, t, lv, cad, to, en, _ in COLLECTORS]
    schema = "collector_name string, target_table string, level string, cadence string, " \
             "timeout_seconds int, enabled boolean"
    return spark.createDataFrame(rows, schema)
