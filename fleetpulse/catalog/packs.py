"""Registered collection transforms (K1-K17) over raw snapshot derivations."""

from __future__ import annotations

from fleetpulse.catalog import register
from fleetpulse.checks.oracle import register as register_cte
from fleetpulse.plans import packs as K
from fleetpulse.sources.raw import BENIGN_WAITS, CURATED_SETTINGS, RawSnapshots, register_oracle

register_oracle()


def raw(spark, sf_dir) -> RawSnapshots:
    return RawSnapshots(spark, sf_dir)


def stamp(alias: str = "", platform: bool = True) -> str:
    p = f"{alias}." if alias else ""
    s = (
        f"CAST(year({p}collected_at) AS SMALLINT) AS year, CAST(month({p}collected_at) AS TINYINT) AS month, "
        f"CAST(day({p}collected_at) AS TINYINT) AS day"
    )
    return ("'sqlserver' AS platform, " + s) if platform else s


def _in(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


@register("backup_status", f"""
WITH k1 AS (
  SELECT instance_id, database_name AS name,
         max(backup_finish_date) FILTER (type = 'D') AS last_full_backup,
         max(backup_finish_date) FILTER (type = 'I') AS last_diff_backup,
         max(backup_finish_date) FILTER (type = 'L') AS last_log_backup,
         max({{'t': backup_finish_date, 'size': backup_size, 'packed': compressed_backup_size}}) FILTER (type = 'D') AS newest
  FROM raw_backupset GROUP BY instance_id, database_name)
SELECT instance_id, database_id, collected_at, {stamp('', False)}, name AS database_name,
       newest.size AS last_full_size_bytes, newest.packed AS last_full_compressed_bytes,
       last_full_backup, last_diff_backup, last_log_backup, log_reuse_wait_desc, recovery_model_desc AS recovery_model
FROM (FROM raw_sysdb WHERE source_database_id IS NULL) LEFT JOIN k1 USING (instance_id, name)""")
def q_backup_status(spark, sf_dir):
    return K.backup_status(raw(spark, sf_dir))


@register("config_settings", f"""
SELECT instance_id, collected_at, name AS setting_name, value AS configured_value,
       value_in_use AS running_value, is_advanced, is_dynamic,
       coalesce(value <> value_in_use, FALSE) AS is_pending
FROM raw_config WHERE name IN ({_in(CURATED_SETTINGS)})""")
def q_config_settings(spark, sf_dir):
    return K.config_settings(raw(spark, sf_dir))


@register("databases_snapshot", """
WITH megabytes AS (
  SELECT instance_id, database_id, trunc(coalesce(sum(size::DOUBLE * 8.0 / 1024) FILTER (type = 0), 0))::INTEGER AS data_file_size_mb,
         trunc(coalesce(sum(size::DOUBLE * 8.0 / 1024) FILTER (type = 1), 0))::INTEGER AS log_file_size_mb
  FROM raw_files GROUP BY instance_id, database_id),
base AS (SELECT * FROM raw_sysdb d WHERE source_database_id IS NULL)
SELECT collected_at, instance_id, database_id, name AS database_name, create_date, state_desc AS state, user_access_desc AS user_access,
       recovery_model_desc AS recovery_model, collation_name, is_read_only, compatibility_level::SMALLINT AS compatibility_level,
       group_database_id IS NOT NULL AS is_alwayson,
       EXISTS (FROM raw_mirroring m WHERE m.mirroring_guid IS NOT NULL AND m.instance_id = base.instance_id
               AND m.database_id = base.database_id) AS is_mirrored,
       (SELECT max(login_name) FROM raw_logins WHERE sid = owner_sid) AS owner_name,
       coalesce(data_file_size_mb, 0) AS data_file_size_mb, coalesce(log_file_size_mb, 0) AS log_file_size_mb, 'sqlserver' AS platform
FROM base LEFT JOIN megabytes USING (instance_id, database_id)""")
def q_databases_snapshot(spark, sf_dir):
    return K.databases_snapshot(raw(spark, sf_dir))


@register("ha_availability_replicas", f"""
SELECT r.instance_id, r.collected_at, {stamp('r', False)}, g.name AS availability_group_name,
       r.replica_server_name, s.role_desc AS replica_role, r.availability_mode_desc AS availability_mode,
       r.failover_mode_desc AS failover_mode, r.seeding_mode_desc AS seeding_mode,
       s.operational_state_desc AS operational_state, s.connected_state_desc AS connected_state,
       s.recovery_health_desc AS recovery_health, s.synchronization_health_desc AS sync_health, s.is_local,
       s.last_connect_error_number, s.last_connect_error_timestamp AS last_connect_error_at
FROM raw_ag_replicas r
JOIN raw_ag_replica_states s ON s.instance_id = r.instance_id AND s.replica_id = r.replica_id
JOIN raw_ag_groups g ON g.group_id = r.group_id""")
def q_ha_availability_replicas(spark, sf_dir):
    return K.ha_availability_replicas(raw(spark, sf_dir))


@register("ha_cluster_members", f"""
SELECT m.instance_id, m.collected_at, {stamp('m', False)}, c.cluster_name, c.quorum_type_desc AS quorum_type,
       c.quorum_state_desc AS quorum_state, m.member_name, m.member_type_desc AS member_type,
       m.member_state_desc AS member_state, CAST(m.number_of_quorum_votes AS TINYINT) AS quorum_votes
FROM raw_cluster_members m JOIN raw_cluster c ON c.instance_id = m.instance_id AND c.collected_at = m.collected_at""")
def q_ha_cluster_members(spark, sf_dir):
    return K.ha_cluster_members(raw(spark, sf_dir))


@register("ha_databases", f"""
SELECT s.instance_id, s.database_id, r.collected_at, {stamp('r', False)}, g.name AS availability_group_name,
       r.replica_server_name AS availability_replica_name,
       s.synchronization_state_desc AS synchronization_state,
       s.synchronization_health_desc AS synchronization_health, s.is_suspended, c.is_failover_ready,
       CAST(NULL AS INTEGER) AS estimated_data_loss_sec,
       s.log_send_queue_size AS log_send_queue_kb, s.redo_queue_size AS redo_queue_kb
FROM raw_ag_db_states s
JOIN raw_ag_replicas r ON r.instance_id = s.instance_id AND r.replica_id = s.replica_id AND r.group_id = s.group_id
JOIN raw_ag_groups g ON g.group_id = s.group_id
LEFT JOIN raw_ag_db_cluster_states c
       ON c.instance_id = s.instance_id AND c.replica_id = s.replica_id AND c.group_database_id = s.group_database_id
WHERE s.is_local""")
def q_ha_databases(spark, sf_dir):
    return K.ha_databases(raw(spark, sf_dir))


K7_SQL = """
SELECT o.instance_id, 'sqlserver' AS platform, o.server_name, o.product_version, 'RTM' AS product_level,
       'Enterprise Edition (64-bit)' AS edition, CAST(3 AS SMALLINT) AS engine_edition,
       'SQL_Latin1_General_CP1_CI_AS' AS collation_default, i.is_clustered, TRUE AS is_full_text_installed,
       o.cpu_count AS logical_cpu_count,
       CAST(o.cpu_count // NULLIF(o.hyperthread_ratio, 0) AS INTEGER) AS physical_cpu_count,
       o.hyperthread_ratio, CAST(o.physical_memory_kb // 1024 AS BIGINT) AS physical_memory_mb,
       CAST(c.min_mem AS INTEGER) AS min_memory_mb, CAST(c.max_mem AS INTEGER) AS max_memory_mb,
       CAST(c.maxdop AS SMALLINT) AS max_dop,
       date_trunc('second', o.sqlserver_start_time + INTERVAL 500 MILLISECOND) AS engine_start_time,
       o.collected_at
FROM raw_osinfo o
LEFT JOIN (SELECT instance_id, collected_at,
                  max(CASE WHEN name = 'min server memory (MB)' THEN value_in_use END) AS min_mem,
                  max(CASE WHEN name = 'max server memory (MB)' THEN value_in_use END) AS max_mem,
                  max(CASE WHEN name = 'max degree of parallelism' THEN value_in_use END) AS maxdop
           FROM raw_config GROUP BY ALL) c ON c.instance_id = o.instance_id AND c.collected_at = o.collected_at
LEFT JOIN instances i ON i.instance_id = o.instance_id"""
register_cte("o_instance_details", K7_SQL)


@register("instance_details", K7_SQL)
def q_instance_details(spark, sf_dir):
    return K.instance_details(raw(spark, sf_dir))


@register("integrity_status", f"""
WITH marked AS (
  SELECT instance_id, database_id, count(*) AS pages FROM raw_suspect GROUP BY instance_id, database_id
  UNION ALL SELECT instance_id, database_id, 0 FROM raw_sysdb),
suspects AS (SELECT instance_id, database_id, max(pages)::INTEGER AS suspect_page_count FROM marked GROUP BY ALL)
SELECT name AS database_name, state_desc AS state, is_read_only, page_verify_option_desc AS page_verify_option,
       suspect_page_count, instance_id, database_id, collected_at, {stamp('', False)}
FROM (FROM raw_sysdb WHERE source_database_id IS NULL) JOIN suspects USING (instance_id, database_id)""")
def q_integrity_status(spark, sf_dir):
    return K.integrity_status(raw(spark, sf_dir))


@register("blocking_counts", f"""
SELECT instance_id, database_id, {stamp()}, collected_at, CAST(count(*) AS INTEGER) AS blocked_session_count
FROM raw_requests WHERE blocking_session_id <> 0 AND database_id > 0
GROUP BY instance_id, database_id, collected_at""")
def q_blocking_counts(spark, sf_dir):
    return K.blocking_counts(raw(spark, sf_dir))


_RING = """
WITH k10_rr AS (
  SELECT instance_id, collected_at,
         CAST(regexp_extract(record, '<SystemIdle>([0-9]+)</SystemIdle>', 1) AS INTEGER) AS system_idle,
         CAST(regexp_extract(record, '<ProcessUtilization>([0-9]+)</ProcessUtilization>', 1) AS INTEGER) AS sql_util,
         CAST(regexp_extract(record, '<Record id="([0-9]+)"', 1) AS INTEGER) AS record_id
  FROM raw_ring
  WHERE ring_buffer_type = 'RING_BUFFER_SCHEDULER_MONITOR' AND record LIKE '%<SystemHealth>%'),
k10_last AS (
  SELECT * FROM k10_rr
  QUALIFY row_number() OVER (PARTITION BY instance_id, collected_at ORDER BY record_id DESC) <= 15),
k10_avg AS (
  SELECT instance_id, collected_at,
         CAST(trunc(sum(sql_util) / count(sql_util)) AS INTEGER) AS engine,
         CAST(trunc(sum(100 - system_idle - sql_util) / count(100 - system_idle - sql_util)) AS INTEGER) AS other,
         CAST(trunc(sum(system_idle) / count(system_idle)) AS INTEGER) AS idle
  FROM k10_last GROUP BY ALL)"""


@register("cpu_from_ring", _RING + f"""
SELECT instance_id, {stamp()}, collected_at, CAST(engine AS SMALLINT) AS engine_cpu_percent,
       CAST(CASE WHEN other < 0 THEN 0 ELSE other END AS SMALLINT) AS other_cpu_percent,
       CAST(idle AS SMALLINT) AS system_idle_percent
FROM k10_avg""")
def q_cpu_from_ring(spark, sf_dir):
    return K.cpu_from_ring(raw(spark, sf_dir))


@register("xml_extract", _RING.replace("WITH k10_rr AS (", "WITH k10_rr AS (", 1) + """
SELECT instance_id, collected_at, system_idle, sql_util, record_id FROM k10_rr""")
def q_xml_extract(spark, sf_dir):
    """XPath integer extraction from XML text."""
    return K.ring_records(raw(spark, sf_dir))


@register("lastn_avg", _RING + """
SELECT instance_id, collected_at, engine, other, idle FROM k10_avg""")
def q_lastn_avg(spark, sf_dir):
    """Truncating averages over the newest 15 records per snapshot."""
    from pyspark.sql import functions as F

    from fleetpulse.operators.windows import topn_per_group

    last = topn_per_group(K.ring_records(raw(spark, sf_dir)), K.SNAPSHOT, [F.col("record_id").desc()], 15)

    def iavg(c):
        return (F.sum(c) / F.count(c)).cast("int")

    return last.groupBy(*K.SNAPSHOT).agg(
        iavg(F.col("sql_util")).alias("engine"),
        iavg(F.lit(100) - F.col("system_idle") - F.col("sql_util")).alias("other"),
        iavg(F.col("system_idle")).alias("idle"),
    )


_IO_COUNTERS = ["num_of_reads", "num_of_bytes_read", "io_stall_read_ms", "num_of_writes",
                "num_of_bytes_written", "io_stall_write_ms", "io_stall", "size_on_disk_bytes"]


@register("database_io_totals", f"""
SELECT a.instance_id, a.database_id, {stamp('a')}, a.collected_at, t.create_date AS last_restart_at,
       {", ".join(f"a.{c}" for c in _IO_COUNTERS)}
FROM (
  SELECT f.instance_id, f.database_id, d.collected_at,
         {", ".join(f"CAST(sum(v.{c}) AS BIGINT) AS {c}" for c in _IO_COUNTERS)}
  FROM raw_files f
  JOIN raw_vfs v ON v.instance_id = f.instance_id AND v.database_id = f.database_id AND v.file_id = f.file_id
  JOIN raw_sysdb d ON d.instance_id = f.instance_id AND d.database_id = f.database_id
  WHERE f.type_desc <> 'FULLTEXT' AND d.state_desc = 'ONLINE'
  GROUP BY f.instance_id, f.database_id, d.collected_at) a
LEFT JOIN raw_tempdb t ON t.instance_id = a.instance_id""")
def q_database_io_totals(spark, sf_dir):
    return K.database_io_totals(raw(spark, sf_dir))


@register("ple_counter", f"""
SELECT instance_id, {stamp()}, collected_at, max(cntr_value) AS page_residency_seconds,
       CAST(NULL AS DECIMAL(5,2)) AS buffer_hit_ratio, CAST(NULL AS INTEGER) AS grants_pending,
       CAST(NULL AS INTEGER) AS grants_outstanding
FROM raw_counters WHERE object_name LIKE '%Buffer Manager%' AND counter_name = 'Page life expectancy'
GROUP BY instance_id, collected_at""")
def q_ple_counter(spark, sf_dir):
    return K.ple_counter(raw(spark, sf_dir))


def _perf_sql() -> str:
    cols = []
    for out, suffix, counter, inst in K.PERF_COUNTERS:
        cond = f"rtrim(object_name) LIKE '%{suffix}' AND rtrim(counter_name) = '{counter}'"
        if inst:
            cond += f" AND rtrim(instance_name) = '{inst}'"
        cols.append(f"max(CASE WHEN {cond} THEN cntr_value END) AS {out}")
    names = ", ".join(f"a.{c[0]}" for c in K.PERF_COUNTERS)
    return f"""
SELECT a.instance_id, {stamp('a')}, a.collected_at, t.create_date AS last_restart_at, {names}
FROM (SELECT instance_id, collected_at, {", ".join(cols)}
      FROM raw_counters WHERE cntr_type = {K.PERF_COUNTER_TYPE} GROUP BY instance_id, collected_at) a
LEFT JOIN raw_tempdb t ON t.instance_id = a.instance_id"""


@register("perf_counters_wide", _perf_sql())
def q_perf_counters_wide(spark, sf_dir):
    return K.perf_counters_wide(raw(spark, sf_dir))


@register("active_sessions", f"""
SELECT c.instance_id, {stamp('c')}, c.collected_at, CAST(coalesce(s.n, 0) AS INTEGER) AS active_sessions
FROM raw_cycles c
LEFT JOIN (SELECT instance_id, collected_at, count(*) FILTER (WHERE login_name <> 'sa' AND is_user_process) AS n
           FROM raw_sessions GROUP BY ALL) s
       ON s.instance_id = c.instance_id AND s.collected_at = c.collected_at""")
def q_active_sessions(spark, sf_dir):
    return K.active_sessions(raw(spark, sf_dir))


@register("top_waits", f"""
SELECT w.instance_id, {stamp('w')}, w.collected_at, t.create_date AS last_restart_at, w.wait_type,
       w.waiting_tasks_count, w.wait_time_ms, w.signal_wait_time_ms, w.max_wait_time_ms
FROM (SELECT * FROM raw_waits
      WHERE wait_type NOT IN ({_in(BENIGN_WAITS)}) AND waiting_tasks_count > 0
      QUALIFY row_number() OVER (PARTITION BY instance_id, collected_at
                                 ORDER BY wait_time_ms DESC, wait_type ASC) <= 25) w
LEFT JOIN raw_tempdb t ON t.instance_id = w.instance_id""")
def q_top_waits(spark, sf_dir):
    return K.top_waits(raw(spark, sf_dir))


@register("mirroring_health", f"""
SELECT m.instance_id, m.database_id, m.collected_at, {stamp('m', False)}, d.name AS database_name,
       m.mirroring_state_desc AS mirroring_state, m.mirroring_role_desc AS mirroring_role,
       m.mirroring_safety_level_desc AS safety_level, m.mirroring_partner_instance AS partner_instance,
       m.mirroring_witness_name AS witness_name, m.mirroring_witness_state_desc AS witness_state,
       CAST(m.mirroring_redo_queue AS BIGINT) AS redo_queue_kb
FROM raw_mirroring m
LEFT JOIN raw_sysdb d ON d.instance_id = m.instance_id AND d.database_id = m.database_id
WHERE m.mirroring_guid IS NOT NULL""")
def q_mirroring_health(spark, sf_dir):
    return K.mirroring_health(raw(spark, sf_dir))


@register("trace_flags", """
SELECT instance_id, collected_at, trace_flag, (status <> 0) AS is_enabled, (global <> 0) AS is_global
FROM raw_trace WHERE global = 1""")
def q_trace_flags(spark, sf_dir):
    return K.trace_flags(raw(spark, sf_dir))
