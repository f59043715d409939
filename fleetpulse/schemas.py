"""Typed table declarations for the fleet lake (two namespaces, 24 tables).

Every read supplies one of these schemas; nothing is inferred. Timestamps are
UTC wall-clock values stored without zone (``TIMESTAMP_NTZ``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

INT = T.IntegerType()
BIGINT = T.LongType()
SMALLINT = T.ShortType()
TINYINT = T.ByteType()
STR = T.StringType()
BOOL = T.BooleanType()
DOUBLE = T.DoubleType()
TS = T.TimestampNTZType()


def _s(*cols: tuple) -> T.StructType:
    fields = []
    for c in cols:
        name, typ = c[0], c[1]
        nullable = c[2] if len(c) > 2 else True
        fields.append(T.StructField(name, typ, nullable))
    return T.StructType(fields)


# Stamp columns every time-series fact row carries.
STAMP = (
    ("instance_id", INT, False),
    ("platform", STR, False),
    ("collected_at", TS, False),
    ("year", SMALLINT, False),
    ("month", TINYINT, False),
    ("day", TINYINT, False),
)
STAMP_NAMES = [c[0] for c in STAMP]

# Partition layouts.
HOT_PARTITIONS = ["platform", "year", "month", "day"]
SCORE_PARTITIONS = ["platform", "year", "month"]
SQLSERVER_PARTITIONS = ["year", "month", "day"]

# ---------------------------------------------------------------- common.*
INSTANCES = _s(
    ("instance_id", INT, False), ("instance_fqn", STR, False), ("instance_name", STR),
    ("platform", STR, False), ("environment", STR), ("status", STR), ("category", STR),
    ("engine_version", STR), ("is_clustered", BOOL), ("dmz", BOOL), ("domain", STR),
    ("auth_mode", STR, False), ("registered_at", TS, False), ("updated_at", TS),
)
# The operational registry: ids are minted here, and ``connect_target`` (which may repeat) is what is dialled.
REGISTRY = _s(
    ("instance_id", INT, False), ("instance_fqn", STR, False), ("instance_name", STR), ("platform", STR, False),
    ("connect_target", STR, False), ("auth_mode", STR, False), ("environment", STR), ("status", STR),
    ("registered_at", TS, False), ("updated_at", TS),
)
DATABASES = _s(
    ("instance_id", INT, False), ("database_id", INT, False), ("platform", STR, False),
    ("database_name", STR, False), ("create_date", TS), ("compatibility_level", SMALLINT),
    ("collation_name", STR), ("recovery_model", STR), ("state", STR), ("user_access", STR),
    ("is_read_only", BOOL), ("is_mirrored", BOOL), ("is_alwayson", BOOL), ("owner_name", STR),
    ("data_file_size_mb", INT), ("log_file_size_mb", INT), ("collected_at", TS, False),
)
INSTANCE_DETAILS = _s(
    ("instance_id", INT, False), ("platform", STR, False), ("server_name", STR),
    ("product_version", STR), ("product_level", STR), ("edition", STR),
    ("engine_edition", SMALLINT), ("collation_default", STR), ("is_clustered", BOOL),
    ("is_full_text_installed", BOOL), ("logical_cpu_count", INT), ("physical_cpu_count", INT),
    ("hyperthread_ratio", INT), ("physical_memory_mb", BIGINT), ("min_memory_mb", INT),
    ("max_memory_mb", INT), ("max_dop", SMALLINT), ("engine_start_time", TS),
    ("collected_at", TS, False),
)
PINGS = _s(*STAMP, ("response_time_ms", INT), ("is_success", BOOL, False))
METRIC_CPU = _s(
    *STAMP, ("engine_cpu_percent", SMALLINT), ("other_cpu_percent", SMALLINT),
    ("system_idle_percent", SMALLINT),
)
METRIC_MEMORY = _s(
    *STAMP, ("page_residency_seconds", BIGINT), ("buffer_hit_ratio", T.DecimalType(5, 2)),
    ("grants_pending", INT), ("grants_outstanding", INT),
)
METRIC_SESSIONS = _s(*STAMP, ("active_sessions", INT))
METRIC_DATABASE_IO = _s(
    ("instance_id", INT, False), ("database_id", INT, False), ("platform", STR, False),
    ("collected_at", TS, False), ("year", SMALLINT, False), ("month", TINYINT, False),
    ("day", TINYINT, False), ("last_restart_at", TS), ("num_of_reads", BIGINT),
    ("num_of_bytes_read", BIGINT), ("io_stall_read_ms", BIGINT), ("num_of_writes", BIGINT),
    ("num_of_bytes_written", BIGINT), ("io_stall_write_ms", BIGINT), ("io_stall", BIGINT),
    ("size_on_disk_bytes", BIGINT),
)
METRIC_BLOCKING = _s(
    ("instance_id", INT, False), ("database_id", INT, False), ("platform", STR, False),
    ("collected_at", TS, False), ("year", SMALLINT, False), ("month", TINYINT, False),
    ("day", TINYINT, False), ("blocked_session_count", INT),
)
METRIC_WAIT_STATS = _s(
    *STAMP, ("last_restart_at", TS), ("wait_type", STR, False), ("waiting_tasks_count", BIGINT),
    ("wait_time_ms", BIGINT), ("signal_wait_time_ms", BIGINT), ("max_wait_time_ms", BIGINT),
)
METRIC_PERF_COUNTERS = _s(
    *STAMP, ("last_restart_at", TS),
    ("batch_requests_per_sec_cumulative", BIGINT), ("sql_compilations_cumulative", BIGINT),
    ("sql_recompilations_cumulative", BIGINT), ("page_reads_cumulative", BIGINT),
    ("page_writes_cumulative", BIGINT), ("lock_waits_cumulative", BIGINT),
    ("deadlocks_cumulative", BIGINT), ("page_splits_cumulative", BIGINT),
    ("transactions_cumulative", BIGINT),
)
COLLECTION_LOG = _s(
    ("instance_id", INT), ("platform", STR), ("collector_name", STR, False),
    ("collected_at", TS, False), ("year", SMALLINT, False), ("month", TINYINT, False),
    ("day", TINYINT, False), ("rows_collected", INT), ("duration_ms", INT), ("status", STR),
)
COLLECTION_ERRORS = _s(
    ("instance_id", INT), ("instance_fqn", STR), ("platform", STR), ("collector_name", STR),
    ("collected_at", TS, False), ("year", SMALLINT, False), ("month", TINYINT, False),
    ("day", TINYINT, False), ("error_type", STR), ("error_message", STR),
)
HEALTH_SCORES = _s(
    ("instance_id", INT, False), ("database_id", INT, False), ("platform", STR, False),
    ("coll_hr", TS, False), ("year", SMALLINT, False), ("month", TINYINT, False),
    ("sql_cpu", SMALLINT), ("idl_cpu", SMALLINT), ("oth_cpu", SMALLINT), ("ple_sec", BIGINT),
    ("read_latency_ms", BIGINT), ("write_latency_ms", BIGINT), ("max_blocking_sessions", INT),
    ("avg_active_sessions", INT), ("blocker_ratio", DOUBLE), ("cpu_index", TINYINT),
    ("memory_index", TINYINT), ("read_latency_index", TINYINT), ("write_latency_index", TINYINT),
    ("blocking_index", TINYINT), ("irc_index", TINYINT),
)
SCORE_THRESHOLDS = _s(
    ("index_name", STR, False), ("direction", STR, False),
    ("warn_threshold", DOUBLE, False), ("crit_threshold", DOUBLE, False),
)

# ------------------------------------------------------------- sqlserver.*
INSTANCE_DETAILS_EXT = _s(
    ("instance_id", INT, False), ("collected_at", TS, False), ("is_hadr_enabled", BOOL),
    ("hadr_manager_status", SMALLINT), ("is_mirrored", BOOL),
    ("available_physical_memory_mb", INT), ("bpool_committed_mb", INT),
    ("bpool_committed_target_mb", INT), ("bpool_visible_target_mb", INT),
    ("deadlocks_per_hour", INT), ("max_workers_count", INT), ("scheduler_count", INT),
    ("virtual_machine_type", INT),
)
_SQL_STAMP = (
    ("collected_at", TS, False), ("year", SMALLINT, False), ("month", TINYINT, False),
    ("day", TINYINT, False),
)
HA_DATABASES = _s(
    ("instance_id", INT, False), ("database_id", INT, False), *_SQL_STAMP,
    ("availability_group_name", STR), ("availability_replica_name", STR),
    ("synchronization_state", STR), ("synchronization_health", STR), ("is_suspended", BOOL),
    ("is_failover_ready", BOOL), ("estimated_data_loss_sec", INT), ("log_send_queue_kb", BIGINT),
    ("redo_queue_kb", BIGINT),
)
CONFIG_SETTINGS = _s(
    ("instance_id", INT, False), ("collected_at", TS, False), ("setting_name", STR, False),
    ("configured_value", BIGINT), ("running_value", BIGINT), ("is_advanced", BOOL),
    ("is_dynamic", BOOL), ("is_pending", BOOL),
)
TRACE_FLAGS = _s(
    ("instance_id", INT, False), ("collected_at", TS, False), ("trace_flag", INT, False),
    ("is_enabled", BOOL), ("is_global", BOOL),
)
BACKUP_STATUS = _s(
    ("instance_id", INT, False), ("database_id", INT, False), *_SQL_STAMP,
    ("database_name", STR), ("recovery_model", STR), ("log_reuse_wait_desc", STR),
    ("last_full_backup", TS), ("last_diff_backup", TS), ("last_log_backup", TS),
    ("last_full_size_bytes", BIGINT), ("last_full_compressed_bytes", BIGINT),
)
INTEGRITY_STATUS = _s(
    ("instance_id", INT, False), ("database_id", INT, False), *_SQL_STAMP,
    ("database_name", STR), ("state", STR), ("page_verify_option", STR), ("is_read_only", BOOL),
    ("suspect_page_count", INT),
)
HA_CLUSTER_MEMBERS = _s(
    ("instance_id", INT, False), *_SQL_STAMP, ("cluster_name", STR), ("quorum_type", STR),
    ("quorum_state", STR), ("member_name", STR), ("member_type", STR), ("member_state", STR),
    ("quorum_votes", TINYINT),
)
HA_AVAILABILITY_REPLICAS = _s(
    ("instance_id", INT, False), *_SQL_STAMP, ("availability_group_name", STR),
    ("replica_server_name", STR), ("replica_role", STR), ("availability_mode", STR),
    ("failover_mode", STR), ("seeding_mode", STR), ("operational_state", STR),
    ("connected_state", STR), ("recovery_health", STR), ("sync_health", STR), ("is_local", BOOL),
    ("last_connect_error_number", INT), ("last_connect_error_at", TS),
)
MIRRORING_HEALTH = _s(
    ("instance_id", INT, False), ("database_id", INT, False), *_SQL_STAMP,
    ("database_name", STR), ("mirroring_state", STR), ("mirroring_role", STR),
    ("safety_level", STR), ("partner_instance", STR), ("witness_name", STR),
    ("witness_state", STR), ("redo_queue_kb", BIGINT),
)

# (namespace, table) -> (schema, partition columns)
TABLES: dict[tuple[str, str], tuple[T.StructType, list[str]]] = {
    ("common", "instances"): (INSTANCES, []),
    ("common", "databases"): (DATABASES, []),
    ("common", "instance_details"): (INSTANCE_DETAILS, []),
    ("common", "pings"): (PINGS, HOT_PARTITIONS),
    ("common", "metric_cpu"): (METRIC_CPU, HOT_PARTITIONS),
    ("common", "metric_memory"): (METRIC_MEMORY, HOT_PARTITIONS),
    ("common", "metric_sessions"): (METRIC_SESSIONS, HOT_PARTITIONS),
    ("common", "metric_database_io"): (METRIC_DATABASE_IO, HOT_PARTITIONS),
    ("common", "metric_blocking"): (METRIC_BLOCKING, HOT_PARTITIONS),
    ("common", "metric_wait_stats"): (METRIC_WAIT_STATS, HOT_PARTITIONS),
    ("common", "metric_perf_counters"): (METRIC_PERF_COUNTERS, HOT_PARTITIONS),
    ("common", "collection_log"): (COLLECTION_LOG, HOT_PARTITIONS),
    ("common", "collection_errors"): (COLLECTION_ERRORS, HOT_PARTITIONS),
    ("common", "health_scores"): (HEALTH_SCORES, SCORE_PARTITIONS),
    ("common", "score_thresholds"): (SCORE_THRESHOLDS, []),
    ("sqlserver", "instance_details_ext"): (INSTANCE_DETAILS_EXT, []),
    ("sqlserver", "ha_databases"): (HA_DATABASES, SQLSERVER_PARTITIONS),
    ("sqlserver", "config_settings"): (CONFIG_SETTINGS, []),
    ("sqlserver", "trace_flags"): (TRACE_FLAGS, []),
    ("sqlserver", "backup_status"): (BACKUP_STATUS, SQLSERVER_PARTITIONS),
    ("sqlserver", "integrity_status"): (INTEGRITY_STATUS, SQLSERVER_PARTITIONS),
    ("sqlserver", "ha_cluster_members"): (HA_CLUSTER_MEMBERS, SQLSERVER_PARTITIONS),
    ("sqlserver", "ha_availability_replicas"): (HA_AVAILABILITY_REPLICAS, SQLSERVER_PARTITIONS),
    ("sqlserver", "mirroring_health"): (MIRRORING_HEALTH, SQLSERVER_PARTITIONS),
}

# The band rules seeded into score_thresholds (index, direction, warn, crit).
THRESHOLD_SEED = [
    ("cpu", "higher_worse", 75.0, 90.0),
    ("memory", "lower_worse", 3600.0, 300.0),
    ("read_latency", "higher_worse", 25.0, 125.0),
    ("write_latency", "higher_worse", 25.0, 125.0),
    ("blocker", "higher_worse", 0.05, 0.15),
]


def schema_of(table: str, namespace: str | None = None) -> T.StructType:
    if namespace is not None:
        return TABLES[(namespace, table)][0]
    hits = [v[0] for (ns, t), v in TABLES.items() if t == table]
    if len(hits) != 1:
        raise KeyError(table)
    return hits[0]


def empty_table(spark: SparkSession, table: str, namespace: str | None = None) -> DataFrame:
    return spark.createDataFrame([], schema_of(table, namespace))


def thresholds_df(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows if rows is not None else THRESHOLD_SEED, SCORE_THRESHOLDS)
