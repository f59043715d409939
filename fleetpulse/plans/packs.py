"""Collection queries (K1-K17) re-aimed as fleet-wide transforms.

Each reference query runs on one server against its system views; here the
input is a raw snapshot table for the whole fleet with ``(instance_id,
collected_at)`` added, so ``TOP n``, global aggregates and scalar subqueries
become per-snapshot operations (group or window by the snapshot key). Outputs
conform to the lake table schemas (stamp columns included).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse import schemas as S
from fleetpulse.functions.scalar import PLATFORM, day_t, month_t, second_round, year_s
from fleetpulse.operators.windows import latest_per_key, topn_per_group
from fleetpulse.sources.raw import BENIGN_WAITS, CURATED_SETTINGS

SNAPSHOT = ["instance_id", "collected_at"]
PERF_COUNTER_TYPE = 272696576


def conform(df: DataFrame, schema, platform: bool = True) -> DataFrame:
    """Add the stamp (platform/year/month/day from collected_at) and order/cast to ``schema``."""
    names = set(df.columns)
    extra = []
    if platform and "platform" not in names:
        extra.append(F.lit(PLATFORM).alias("platform"))
    for n, fn in (("year", year_s), ("month", month_t), ("day", day_t)):
        if n not in names:
            extra.append(fn("collected_at").alias(n))
    df = df.select("*", *extra)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def _restart(raw) -> DataFrame:
    """The per-instance scalar (tempdb create date) joined onto each snapshot row."""
    return raw.raw_tempdb.select("instance_id", F.col("create_date").alias("last_restart_at"))


# ----------------------------------------------------------------- K1
def backup_status(raw) -> DataFrame:
    """K1: last full/diff/log backup (A16) and newest full's size (J10) per database."""
    db = raw.raw_sysdb.filter(F.col("source_database_id").isNull())
    bs = raw.raw_backupset
    latest = bs.groupBy("instance_id", "database_name").agg(
        F.max(F.when(F.col("type") == "D", F.col("backup_finish_date"))).alias("last_full_backup"),
        F.max(F.when(F.col("type") == "I", F.col("backup_finish_date"))).alias("last_diff_backup"),
        F.max(F.when(F.col("type") == "L", F.col("backup_finish_date"))).alias("last_log_backup"),
    )
    newest_full = latest_per_key(
        bs.filter(F.col("type") == "D"),
        keys=["instance_id", "database_name"],
        order=["backup_finish_date"],
        tiebreak=["backup_size", "compressed_backup_size"],
        columns=["instance_id", "database_name", "backup_size", "compressed_backup_size"],
    )
    out = (
        db.select("instance_id", "collected_at", "database_id", F.col("name").alias("database_name"),
                  F.col("recovery_model_desc").alias("recovery_model"), "log_reuse_wait_desc")
        .join(latest, ["instance_id", "database_name"], "left")
        .join(newest_full, ["instance_id", "database_name"], "left")
        .withColumnRenamed("backup_size", "last_full_size_bytes")
        .withColumnRenamed("compressed_backup_size", "last_full_compressed_bytes")
    )
    return conform(out, S.BACKUP_STATUS, platform=False)


# ----------------------------------------------------------------- K2
def config_settings(raw) -> DataFrame:
    """K2: the curated settings with a pending-change flag (F16), ordered."""
    c = raw.raw_config.filter(F.col("name").isin(*CURATED_SETTINGS))
    out = c.select(
        "instance_id", "collected_at", F.col("name").alias("setting_name"),
        F.col("value").alias("configured_value"), F.col("value_in_use").alias("running_value"),
        "is_advanced", "is_dynamic",
        F.coalesce(F.col("value") != F.col("value_in_use"), F.lit(False)).alias("is_pending"),
    )
    return conform(out, S.CONFIG_SETTINGS, platform=False).orderBy("instance_id", "collected_at", "setting_name")


# ----------------------------------------------------------------- K3
def databases_snapshot(raw) -> DataFrame:
    """K3: database attributes, data/log size (J13 as one conditional aggregate), flags, owner."""
    db = raw.raw_sysdb.filter(F.col("source_database_id").isNull())
    size_mb = F.col("size") * F.lit(8.0) / F.lit(1024)
    files = raw.raw_files.groupBy("instance_id", "database_id").agg(
        F.sum(F.when(F.col("type") == 0, size_mb)).alias("data_mb"),
        F.sum(F.when(F.col("type") == 1, size_mb)).alias("log_mb"),
    )
    mirrored = raw.raw_mirroring.filter(F.col("mirroring_guid").isNotNull()).select(
        "instance_id", "database_id", F.lit(True).alias("_m")
    )
    logins = raw.raw_logins.select(F.col("sid").alias("owner_sid"), "login_name")
    out = (
        db.join(files, ["instance_id", "database_id"], "left")
        .join(mirrored, ["instance_id", "database_id"], "left")
        .join(logins, "owner_sid", "left")
        .select(
            "instance_id", "database_id", F.col("name").alias("database_name"), "create_date",
            "compatibility_level", "collation_name", F.col("recovery_model_desc").alias("recovery_model"),
            F.col("state_desc").alias("state"), F.col("user_access_desc").alias("user_access"),
            "is_read_only", F.col("_m").isNotNull().alias("is_mirrored"),
            F.col("group_database_id").isNotNull().alias("is_alwayson"),
            F.col("login_name").alias("owner_name"),
            F.coalesce("data_mb", F.lit(0)).cast("int").alias("data_file_size_mb"),
            F.coalesce("log_mb", F.lit(0)).cast("int").alias("log_file_size_mb"),
            "collected_at",
        )
    )
    return conform(out, S.DATABASES)


# ----------------------------------------------------------------- K4
def ha_availability_replicas(raw) -> DataFrame:
    """K4: replica + state + group (two inner joins on ids)."""
    r = raw.raw_ag_replicas
    st = raw.raw_ag_replica_states
    g = raw.raw_ag_groups
    out = r.join(st, ["instance_id", "replica_id"]).join(g, "group_id").select(
        "instance_id", "collected_at", F.col("name").alias("availability_group_name"),
        "replica_server_name", F.col("role_desc").alias("replica_role"),
        F.col("availability_mode_desc").alias("availability_mode"),
        F.col("failover_mode_desc").alias("failover_mode"), F.col("seeding_mode_desc").alias("seeding_mode"),
        F.col("operational_state_desc").alias("operational_state"),
        F.col("connected_state_desc").alias("connected_state"),
        F.col("recovery_health_desc").alias("recovery_health"),
        F.col("synchronization_health_desc").alias("sync_health"), "is_local",
        "last_connect_error_number", F.col("last_connect_error_timestamp").alias("last_connect_error_at"),
    )
    return conform(out, S.HA_AVAILABILITY_REPLICAS, platform=False)


# ----------------------------------------------------------------- K5
def ha_cluster_members(raw) -> DataFrame:
    """K5: members x their instance's one-row cluster (equi-join on the snapshot key)."""
    out = raw.raw_cluster_members.join(raw.raw_cluster, SNAPSHOT).select(
        "instance_id", "collected_at", "cluster_name", F.col("quorum_type_desc").alias("quorum_type"),
        F.col("quorum_state_desc").alias("quorum_state"), "member_name",
        F.col("member_type_desc").alias("member_type"), F.col("member_state_desc").alias("member_state"),
        F.col("number_of_quorum_votes").alias("quorum_votes"),
    )
    return conform(out, S.HA_CLUSTER_MEMBERS, platform=False)


# ----------------------------------------------------------------- K6
def ha_databases(raw) -> DataFrame:
    """K6: local database replicas; 2 inner + 1 left two-key joins; constant NULL column."""
    drs = raw.raw_ag_db_states.filter(F.col("is_local"))
    ar = raw.raw_ag_replicas.select("instance_id", "replica_id", "group_id", "replica_server_name", "collected_at")
    ag = raw.raw_ag_groups
    cs = raw.raw_ag_db_cluster_states
    out = (
        drs.join(ar, ["instance_id", "replica_id", "group_id"])
        .join(ag, "group_id")
        .join(cs, ["instance_id", "replica_id", "group_database_id"], "left")
        .select(
            "instance_id", "database_id", "collected_at",
            F.col("name").alias("availability_group_name"),
            F.col("replica_server_name").alias("availability_replica_name"),
            F.col("synchronization_state_desc").alias("synchronization_state"),
            F.col("synchronization_health_desc").alias("synchronization_health"),
            "is_suspended", "is_failover_ready",
            F.lit(None).cast("int").alias("estimated_data_loss_sec"),
            F.col("log_send_queue_size").alias("log_send_queue_kb"),
            F.col("redo_queue_size").alias("redo_queue_kb"),
        )
    )
    return conform(out, S.HA_DATABASES, platform=False)


# ----------------------------------------------------------------- K7
def instance_details(raw) -> DataFrame:
    """K7: one row per instance snapshot; integer division (F14), three settings lookups."""
    osi = raw.raw_osinfo
    cfg = raw.raw_config.groupBy(*SNAPSHOT).agg(
        F.max(F.when(F.col("name") == "min server memory (MB)", F.col("value_in_use"))).alias("min_mem"),
        F.max(F.when(F.col("name") == "max server memory (MB)", F.col("value_in_use"))).alias("max_mem"),
        F.max(F.when(F.col("name") == "max degree of parallelism", F.col("value_in_use"))).alias("maxdop"),
    )
    inst = raw.lake.instances.select("instance_id", "is_clustered")
    out = osi.join(cfg, SNAPSHOT, "left").join(inst, "instance_id", "left").select(
        "instance_id", "server_name", "product_version", F.lit("RTM").alias("product_level"),
        F.lit("Enterprise Edition (64-bit)").alias("edition"), F.lit(3).alias("engine_edition"),
        F.lit("SQL_Latin1_General_CP1_CI_AS").alias("collation_default"), "is_clustered",
        F.lit(True).alias("is_full_text_installed"),
        F.col("cpu_count").alias("logical_cpu_count"),
        (F.col("cpu_count") / F.nullif(F.col("hyperthread_ratio"), F.lit(0))).cast("int").alias("physical_cpu_count"),
        "hyperthread_ratio",
        F.expr("physical_memory_kb div 1024").alias("physical_memory_mb"),
        F.col("min_mem").alias("min_memory_mb"), F.col("max_mem").alias("max_memory_mb"),
        F.col("maxdop").alias("max_dop"),
        second_round("sqlserver_start_time").alias("engine_start_time"),
        "collected_at",
    )
    return conform(out, S.INSTANCE_DETAILS)


# ----------------------------------------------------------------- K8
def integrity_status(raw) -> DataFrame:
    """K8: database state + suspect page count (J12: pre-aggregate, left join, coalesce 0)."""
    db = raw.raw_sysdb.filter(F.col("source_database_id").isNull())
    sp = raw.raw_suspect.groupBy("instance_id", "database_id").agg(F.count(F.lit(1)).alias("n"))
    out = db.join(sp, ["instance_id", "database_id"], "left").select(
        "instance_id", "database_id", "collected_at", F.col("name").alias("database_name"),
        F.col("state_desc").alias("state"), F.col("page_verify_option_desc").alias("page_verify_option"),
        "is_read_only", F.coalesce("n", F.lit(0)).alias("suspect_page_count"),
    )
    return conform(out, S.INTEGRITY_STATUS, platform=False)


# ----------------------------------------------------------------- K9
def blocking_counts(raw) -> DataFrame:
    """K9 (A14): blocked requests per database per snapshot; no row when zero."""
    r = raw.raw_requests.filter((F.col("blocking_session_id") != 0) & (F.col("database_id") > 0))
    out = r.groupBy("instance_id", "collected_at", "database_id").agg(
        F.count(F.lit(1)).alias("blocked_session_count")
    )
    return conform(out, S.METRIC_BLOCKING)


# ----------------------------------------------------------------- K10
RING_IDLE = "/Record/SchedulerMonitorEvent/SystemHealth/SystemIdle"
RING_UTIL = "/Record/SchedulerMonitorEvent/SystemHealth/ProcessUtilization"
RING_LAST_N = 15


def ring_records(raw) -> DataFrame:
    """parse scheduler-monitor records with XPath."""
    r = raw.raw_ring.filter(
        (F.col("ring_buffer_type") == "RING_BUFFER_SCHEDULER_MONITOR")
        & F.col("record").like("%<SystemHealth>%")
    )
    return r.select(
        "instance_id", "collected_at",
        F.xpath_int("record", F.lit(RING_IDLE)).alias("system_idle"),
        F.xpath_int("record", F.lit(RING_UTIL)).alias("sql_util"),
        F.xpath_int("record", F.lit("/Record/@id")).alias("record_id"),
    )


def cpu_from_ring(raw) -> DataFrame:
    """Last 15 records (W7), truncating integer averages (F14), clamp (F13), none if empty."""
    last = topn_per_group(ring_records(raw), SNAPSHOT, [F.col("record_id").desc()], RING_LAST_N)

    def iavg(c):  # T-SQL AVG over INT truncates toward zero
        return (F.sum(c) / F.count(c)).cast("int")

    agg = last.groupBy(*SNAPSHOT).agg(
        iavg(F.col("sql_util")).alias("engine"),
        iavg(F.lit(100) - F.col("system_idle") - F.col("sql_util")).alias("other"),
        iavg(F.col("system_idle")).alias("idle"),
    )
    out = agg.select(
        *SNAPSHOT, F.col("engine").alias("engine_cpu_percent"),
        F.when(F.col("other") < 0, 0).otherwise(F.col("other")).alias("other_cpu_percent"),
        F.col("idle").alias("system_idle_percent"),
    )
    return conform(out, S.METRIC_CPU)


# ----------------------------------------------------------------- K11
def database_io_totals(raw) -> DataFrame:
    """Files x file stats x databases, FULLTEXT and offline excluded, 8 sums, restart."""
    f = raw.raw_files.filter(F.col("type_desc") != "FULLTEXT").select("instance_id", "database_id", "file_id")
    v = raw.raw_vfs
    d = raw.raw_sysdb.filter(F.col("state_desc") == "ONLINE").select("instance_id", "database_id", "collected_at")
    counters = ["num_of_reads", "num_of_bytes_read", "io_stall_read_ms", "num_of_writes",
                "num_of_bytes_written", "io_stall_write_ms", "io_stall", "size_on_disk_bytes"]
    agg = (
        f.join(v, ["instance_id", "database_id", "file_id"])
        .join(d, ["instance_id", "database_id"])
        .groupBy("instance_id", "database_id", "collected_at")
        .agg(*[F.sum(c).alias(c) for c in counters])
    )
    out = agg.join(_restart(raw), "instance_id", "left")
    return conform(out, S.METRIC_DATABASE_IO)


# ----------------------------------------------------------------- K12
def ple_counter(raw) -> DataFrame:
    """The Buffer Manager page life expectancy per snapshot (largest value when repeated)."""
    c = raw.raw_counters.filter(
        F.col("object_name").like("%Buffer Manager%") & (F.col("counter_name") == "Page life expectancy")
    )
    out = c.groupBy(*SNAPSHOT).agg(F.max("cntr_value").alias("page_residency_seconds"))
    out = out.select(
        "*", F.lit(None).cast("decimal(5,2)").alias("buffer_hit_ratio"),
        F.lit(None).cast("int").alias("grants_pending"), F.lit(None).cast("int").alias("grants_outstanding"),
    )
    return conform(out, S.METRIC_MEMORY)


# ----------------------------------------------------------------- K13
# Fixed values: (output column, object suffix, counter name, instance name or None).
PERF_COUNTERS = (
    ("batch_requests_per_sec_cumulative", ":SQL Statistics", "Batch Requests/sec", None),
    ("sql_compilations_cumulative", ":SQL Statistics", "SQL Compilations/sec", None),
    ("sql_recompilations_cumulative", ":SQL Statistics", "SQL Re-Compilations/sec", None),
    ("page_reads_cumulative", ":Buffer Manager", "Page reads/sec", None),
    ("page_writes_cumulative", ":Buffer Manager", "Page writes/sec", None),
    ("lock_waits_cumulative", ":Locks", "Lock Waits/sec", "_Total"),
    ("deadlocks_cumulative", ":Locks", "Number of Deadlocks/sec", "_Total"),
    ("page_splits_cumulative", ":Access Methods", "Page Splits/sec", None),
    ("transactions_cumulative", ":Databases", "Transactions/sec", "_Total"),
)


def perf_counters_wide(raw) -> DataFrame:
    """Nine conditional maxima over counter rows (F11 ``RTRIM .. LIKE``), plus restart."""
    c = raw.raw_counters.filter(F.col("cntr_type") == PERF_COUNTER_TYPE)
    obj, ctr, ins = F.rtrim("object_name"), F.rtrim("counter_name"), F.rtrim("instance_name")
    aggs = []
    for out, suffix, counter, inst in PERF_COUNTERS:
        cond = obj.endswith(suffix) & (ctr == counter)
        if inst is not None:
            cond = cond & (ins == inst)
        aggs.append(F.max(F.when(cond, F.col("cntr_value"))).alias(out))
    out = c.groupBy(*SNAPSHOT).agg(*aggs).join(_restart(raw), "instance_id", "left")
    return conform(out, S.METRIC_PERF_COUNTERS)


# ----------------------------------------------------------------- K14
def active_sessions(raw) -> DataFrame:
    """User sessions not logged in as ``sa``; a cycle with none still emits 0."""
    s = raw.raw_sessions.groupBy(*SNAPSHOT).agg(
        F.count_if((F.col("login_name") != "sa") & F.col("is_user_process")).alias("n")
    )
    out = raw.raw_cycles.join(s, SNAPSHOT, "left").select(
        *SNAPSHOT, F.coalesce("n", F.lit(0)).alias("active_sessions")
    )
    return conform(out, S.METRIC_SESSIONS)


# ----------------------------------------------------------------- K15
TOP_WAITS = 25


def top_waits(raw) -> DataFrame:
    """Benign waits removed (F10), ``tasks > 0``, top 25 by wait time per snapshot."""
    w = raw.raw_waits.filter(~F.col("wait_type").isin(*BENIGN_WAITS) & (F.col("waiting_tasks_count") > 0))
    top = topn_per_group(w, SNAPSHOT, [F.col("wait_time_ms").desc(), F.col("wait_type").asc()], TOP_WAITS)
    out = top.join(_restart(raw), "instance_id", "left")
    return conform(out, S.METRIC_WAIT_STATS)


# ----------------------------------------------------------------- K16
def mirroring_health(raw) -> DataFrame:
    """Mirrored databases only, name lookup (F22), BIGINT cast."""
    m = raw.raw_mirroring.filter(F.col("mirroring_guid").isNotNull())
    names = raw.raw_sysdb.select("instance_id", "database_id", F.col("name").alias("database_name"))
    out = m.join(names, ["instance_id", "database_id"], "left").select(
        "instance_id", "database_id", "collected_at", "database_name",
        F.col("mirroring_state_desc").alias("mirroring_state"),
        F.col("mirroring_role_desc").alias("mirroring_role"),
        F.col("mirroring_safety_level_desc").alias("safety_level"),
        F.col("mirroring_partner_instance").alias("partner_instance"),
        F.col("mirroring_witness_name").alias("witness_name"),
        F.col("mirroring_witness_state_desc").alias("witness_state"),
        F.col("mirroring_redo_queue").cast("bigint").alias("redo_queue_kb"),
    )
    return conform(out, S.MIRRORING_HEALTH, platform=False)


# ----------------------------------------------------------------- K17
def trace_flags(raw) -> DataFrame:
    """Globally enabled trace flags, ordered by flag."""
    t = raw.raw_trace.filter(F.col("global") == 1).select(
        "instance_id", "collected_at", "trace_flag",
        (F.col("status") != 0).alias("is_enabled"), (F.col("global") != 0).alias("is_global"),
    )
    return conform(t, S.TRACE_FLAGS, platform=False).orderBy("instance_id", "collected_at", "trace_flag")
