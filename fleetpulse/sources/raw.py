"""Raw collection snapshots derived from the input tables.

The collection queries of the reference read a server's system views. Here the
input is a *raw snapshot table* holding those rows for the whole fleet, keyed
by ``(instance_id, collected_at)``. Each raw table is a small integer-only SQL
definition over the input tables, rendered for Spark (``spark.sql`` with
DataFrame arguments, no global views) and for the DuckDB oracle, so both engines
see identical inputs.

Placeholders: ``{ts:...}`` timestamp literal, ``{hr:x}`` / ``{mon:x}`` hour and
month buckets, ``{addh:x,n}`` add n hours, ``{addd:x,n}`` add n days,
``{mkts:s}`` 2023-12-01 plus s seconds (fractional), ``{div}`` integer division,
``{T}`` a table reference (Spark DataFrame argument / DuckDB name).
"""

from __future__ import annotations

import re
from pyspark.sql import DataFrame, SparkSession

# The benign wait types excluded from the top-waits collection (80 names).
BENIGN_WAITS = [
    "SLEEP_TASK",
    "SLEEP_SYSTEMTASK",
    "SLEEP_BPOOL_FLUSH",
    "SLEEP_DBSTARTUP",
    "SLEEP_DCOMSTARTUP",
    "SLEEP_MASTERDBREADY",
    "SLEEP_MASTERMDREADY",
    "SLEEP_MASTERUPGRADED",
    "SLEEP_MSDBSTARTUP",
    "SLEEP_TEMPDBSTARTUP",
    "LAZYWRITER_SLEEP",
    "WAITFOR",
    "WAITFOR_TASKSHUTDOWN",
    "WAIT_FOR_RESULTS",
    "SERVER_IDLE_CHECK",
    "KSOURCE_WAKEUP",
    "CHECKPOINT_QUEUE",
    "CHKPT",
    "LOGMGR_QUEUE",
    "DIRTY_PAGE_POLL",
    "REDO_THREAD_PENDING_WORK",
    "BROKER_EVENTHANDLER",
    "BROKER_RECEIVE_WAITFOR",
    "BROKER_TASK_STOP",
    "BROKER_TO_FLUSH",
    "BROKER_TRANSMITTER",
    "CLR_AUTO_EVENT",
    "CLR_MANUAL_EVENT",
    "CLR_SEMAPHORE",
    "DISPATCHER_QUEUE_SEMAPHORE",
    "ONDEMAND_TASK_QUEUE",
    "SOS_WORK_DISPATCHER",
    "XE_DISPATCHER_JOIN",
    "XE_DISPATCHER_WAIT",
    "XE_TIMER_EVENT",
    "XE_BUFFERMGR_ALLPROCESSED_EVENT",
    "XE_LIVE_TARGET_TVF",
    "FT_IFTS_SCHEDULER_IDLE_WAIT",
    "FT_IFTSHC_MUTEX",
    "FSAGENT",
    "DBMIRROR_DBM_EVENT",
    "DBMIRROR_EVENTS_QUEUE",
    "DBMIRROR_WORKER_QUEUE",
    "DBMIRRORING_CMD",
    "HADR_CLUSAPI_CALL",
    "HADR_FILESTREAM_IOMGR_IOCOMPLETION",
    "HADR_LOGCAPTURE_WAIT",
    "HADR_NOTIFICATION_DEQUEUE",
    "HADR_TIMER_TASK",
    "HADR_WORK_QUEUE",
    "PARALLEL_REDO_DRAIN_WORKER",
    "PARALLEL_REDO_LOG_CACHE",
    "PARALLEL_REDO_TRAN_LIST",
    "PARALLEL_REDO_WORKER_SYNC",
    "PARALLEL_REDO_WORKER_WAIT_WORK",
    "QDS_PERSIST_TASK_MAIN_LOOP_SLEEP",
    "QDS_ASYNC_QUEUE",
    "QDS_CLEANUP_STALE_QUERIES_TASK_MAIN_LOOP_SLEEP",
    "QDS_SHUTDOWN_QUEUE",
    "WAIT_XTP_CKPT_CLOSE",
    "WAIT_XTP_HOST_WAIT",
    "WAIT_XTP_OFFLINE_CKPT_NEW_LOG",
    "WAIT_XTP_RECOVERY",
    "SP_SERVER_DIAGNOSTICS_SLEEP",
    "SQLTRACE_BUFFER_FLUSH",
    "SQLTRACE_INCREMENTAL_FLUSH_SLEEP",
    "SQLTRACE_WAIT_ENTRIES",
    "REQUEST_FOR_DEADLOCK_SEARCH",
    "RESOURCE_QUEUE",
    "EXECSYNC",
    "SNI_HTTP_ACCEPT",
    "PWAIT_ALL_COMPONENTS_INITIALIZED",
    "PWAIT_DIRECTLOGCONSUMER_GETNEXT",
    "VDI_CLIENT_OTHER",
    "MEMORY_ALLOCATION_EXT",
    "PVS_PREALLOCATE",
    "PREEMPTIVE_XE_GETTARGETSTATE",
    "PREEMPTIVE_OS_FLUSHFILEBUFFERS",
    "PREEMPTIVE_OS_AUTHENTICATIONOPS",
    "PREEMPTIVE_OS_GETPROCADDRESS",
]

# The 12 curated configuration settings.
CURATED_SETTINGS = (
    "max degree of parallelism",
    "cost threshold for parallelism",
    "max server memory (MB)",
    "min server memory (MB)",
    "optimize for ad hoc workloads",
    "priority boost",
    "lightweight pooling",
    "backup compression default",
    "remote admin connections",
    "fill factor (%)",
    "tempdb metadata memory-optimized",
    "automatic soft-NUMA disabled",
)

SNAP = "{ts:2024-01-31 00:00:00}"

_setting_case = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(CURATED_SETTINGS))

RAW: dict[str, str] = {
    # sys.dm_os_wait_stats per instance and month (cumulative counters).
    "raw_waits": """
SELECT CAST(1000 + l_suppkey AS INT) AS instance_id, {mon:l_shipdate} AS collected_at,
       CASE l_partkey % 40 WHEN 0 THEN 'SLEEP_TASK' WHEN 1 THEN 'WAITFOR' WHEN 2 THEN 'CHECKPOINT_QUEUE'
            ELSE 'WAIT_' || CAST(l_partkey % 40 AS STRING) END AS wait_type,
       CAST(COUNT(*) - 1 AS BIGINT) AS waiting_tasks_count,
       CAST(SUM(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS wait_time_ms,
       CAST(SUM(l_linenumber) AS BIGINT) AS signal_wait_time_ms,
       CAST(MAX(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS max_wait_time_ms
FROM {lineitem}
GROUP BY 1, 2, 3""",
    # tempdb create date per instance = last restart.
    "raw_tempdb": """
SELECT instance_id, {addd:registered_at,instance_id % 60} AS create_date FROM {instances}""",
    # Scheduler-monitor ring buffer records (XML text), one cycle per instance-hour.
    "raw_ring": """
SELECT instance_id, {hr:ts} AS collected_at, 'RING_BUFFER_SCHEDULER_MONITOR' AS ring_buffer_type,
       CASE WHEN event_id % 13 = 0
            THEN '<Record id="' || CAST(event_id AS STRING) || '"><Other/></Record>'
            ELSE '<Record id="' || CAST(event_id AS STRING) || '"><SchedulerMonitorEvent><SystemHealth>'
                 || '<SystemIdle>' || CAST(event_id % 60 AS STRING) || '</SystemIdle>'
                 || '<ProcessUtilization>' || CAST(event_id % 40 AS STRING) || '</ProcessUtilization>'
                 || '</SystemHealth></SchedulerMonitorEvent></Record>' END AS record
FROM {ev} WHERE event_type = 'view'""",
    # sys.dm_os_performance_counters per instance and month.
    "raw_counters": """
SELECT CAST(1000 + l_suppkey AS INT) AS instance_id, {mon:l_shipdate} AS collected_at,
       CASE l_linenumber WHEN 1 THEN 'SQLServer:SQL Statistics' WHEN 2 THEN 'SQLServer:SQL Statistics'
            WHEN 3 THEN 'SQLServer:Buffer Manager' WHEN 4 THEN 'SQLServer:Buffer Manager'
            WHEN 5 THEN 'SQLServer:Locks' WHEN 6 THEN 'SQLServer:Access Methods'
            ELSE 'SQLServer:Databases' END
         || CASE WHEN l_orderkey % 2 = 0 THEN '   ' ELSE '' END AS object_name,
       CASE l_linenumber WHEN 1 THEN 'Batch Requests/sec' WHEN 2 THEN 'SQL Compilations/sec'
            WHEN 3 THEN 'Page life expectancy' WHEN 4 THEN 'Page reads/sec'
            WHEN 5 THEN 'Lock Waits/sec' WHEN 6 THEN 'Page Splits/sec' ELSE 'Transactions/sec' END
         || CASE WHEN l_orderkey % 5 = 0 THEN ' ' ELSE '' END AS counter_name,
       CASE WHEN l_linenumber IN (5, 7) AND l_orderkey % 3 = 0 THEN 'tempdb'
            WHEN l_linenumber IN (5, 7) THEN '_Total' ELSE '' END AS instance_name,
       CAST(CASE WHEN l_returnflag = 'R' THEN 65792 ELSE 272696576 END AS INT) AS cntr_type,
       CAST(floor(l_extendedprice) AS BIGINT) AS cntr_value
FROM {lineitem}""",
    # Sessions seen in each instance-hour cycle (error events carry no session row).
    "raw_sessions": """
SELECT instance_id, {hr:ts} AS collected_at, event_id AS session_id,
       CASE WHEN event_id % 7 = 0 THEN 'sa' ELSE 'user_' || CAST(user_id AS STRING) END AS login_name,
       (event_id % 5 <> 0) AS is_user_process
FROM {ev} WHERE event_type <> 'error'""",
    # The collection cycles (instance, hour) that ran.
    "raw_cycles": """
SELECT DISTINCT instance_id, {hr:ts} AS collected_at FROM {ev}""",
    # sys.dm_exec_requests at each cycle.
    "raw_requests": """
SELECT instance_id, {hr:ts} AS collected_at, event_id AS session_id,
       CAST(CASE WHEN event_id % 11 = 0 THEN 0 ELSE database_id END AS INT) AS database_id,
       CAST(event_id % 3 AS INT) AS blocking_session_id
FROM {ev} WHERE event_type = 'error'""",
    # sys.databases per instance (one catalog snapshot).
    "raw_sysdb": f"""
SELECT CAST(1000 + p_partkey {{div}} 20 AS INT) AS instance_id, {SNAP} AS collected_at,
       CAST(p_partkey % 20 AS INT) AS database_id,
       CASE WHEN p_partkey % 20 = 2 THEN 'tempdb' ELSE 'db_' || CAST(p_partkey % 20 AS STRING) END AS name,
       CASE WHEN p_partkey % 23 = 5 THEN 1 END AS source_database_id,
       {{addd:{{ts:2023-01-01 00:00:00}},p_partkey % 365}} AS create_date,
       CAST(150 + (p_partkey % 3) * 10 AS INT) AS compatibility_level,
       'SQL_Latin1_General_CP1_CI_AS' AS collation_name,
       CASE p_size % 3 WHEN 0 THEN 'FULL' WHEN 1 THEN 'SIMPLE' ELSE 'BULK_LOGGED' END AS recovery_model_desc,
       CASE WHEN p_size % 4 = 0 THEN 'LOG_BACKUP' ELSE 'NOTHING' END AS log_reuse_wait_desc,
       CASE WHEN p_partkey % 17 = 0 THEN 'OFFLINE' ELSE 'ONLINE' END AS state_desc,
       'MULTI_USER' AS user_access_desc, (p_partkey % 19 = 0) AS is_read_only,
       CASE WHEN p_partkey % 7 = 0 THEN 'TORN_PAGE_DETECTION' ELSE 'CHECKSUM' END AS page_verify_option_desc,
       CAST(p_partkey % 6 AS INT) AS owner_sid,
       CASE WHEN p_partkey % 6 = 1 THEN 'grp' END AS group_database_id
FROM {{part}}""",
    # Login names by sid (SUSER_SNAME); sid 5 has no login.
    "raw_logins": """
SELECT CAST(r_regionkey AS INT) AS sid,
       CASE WHEN r_regionkey = 0 THEN 'sa' ELSE lower(replace(r_name, ' ', '_')) END AS login_name
FROM {region}""",
    # sys.master_files, one row per (instance, database, file).
    "raw_files": """
SELECT CAST(1000 + l_partkey {div} 20 AS INT) AS instance_id, CAST(l_partkey % 20 AS INT) AS database_id,
       CAST(l_linenumber AS INT) AS file_id, CAST(l_linenumber % 3 AS INT) AS type,
       CASE l_linenumber % 3 WHEN 0 THEN 'ROWS' WHEN 1 THEN 'LOG' ELSE 'FULLTEXT' END AS type_desc,
       CAST(SUM(CAST(floor(l_quantity) AS BIGINT) * 129) AS BIGINT) AS size
FROM {lineitem} GROUP BY 1, 2, 3, 4, 5""",
    # sys.dm_io_virtual_file_stats, cumulative per file.
    "raw_vfs": """
SELECT CAST(1000 + l_partkey {div} 20 AS INT) AS instance_id, CAST(l_partkey % 20 AS INT) AS database_id,
       CAST(l_linenumber AS INT) AS file_id,
       CAST(SUM(l_orderkey % 1000) AS BIGINT) AS num_of_reads,
       CAST(SUM((l_orderkey % 1000) * 8192) AS BIGINT) AS num_of_bytes_read,
       CAST(SUM(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS io_stall_read_ms,
       CAST(SUM(l_orderkey % 700) AS BIGINT) AS num_of_writes,
       CAST(SUM((l_orderkey % 700) * 8192) AS BIGINT) AS num_of_bytes_written,
       CAST(SUM(CAST(floor(l_extendedprice / 3) AS BIGINT)) AS BIGINT) AS io_stall_write_ms,
       CAST(SUM(CAST(floor(l_extendedprice) AS BIGINT) + CAST(floor(l_extendedprice / 3) AS BIGINT)) AS BIGINT) AS io_stall,
       CAST(SUM(CAST(floor(l_quantity) AS BIGINT) * 1048576) AS BIGINT) AS size_on_disk_bytes
FROM {lineitem} WHERE l_returnflag <> 'N' GROUP BY 1, 2, 3""",
    # msdb.dbo.backupset.
    "raw_backupset": """
SELECT CAST(1000 + o_custkey {div} 15 AS INT) AS instance_id,
       'db_' || CAST(o_custkey % 15 AS STRING) AS database_name,
       CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'O' THEN 'I' ELSE 'L' END AS type,
       o_orderdate AS backup_finish_date,
       CAST(floor(o_totalprice) AS BIGINT) AS backup_size,
       CAST(floor(o_totalprice / 3) AS BIGINT) AS compressed_backup_size
FROM {orders}""",
    # msdb.dbo.suspect_pages.
    "raw_suspect": """
SELECT CAST(1000 + l_partkey {div} 20 AS INT) AS instance_id, CAST(l_partkey % 20 AS INT) AS database_id,
       l_orderkey AS page_id
FROM {lineitem} WHERE l_returnflag = 'R' AND l_linestatus = 'F'""",
    # sys.configurations snapshots: 12 curated names plus 8 others.
    "raw_config": f"""
SELECT CAST(1000 + 2 * (p_partkey {{div}} 40) AS INT) AS instance_id,
       {{addh:{{ts:2024-01-01 00:00:00}},p_partkey {{div}} 20 % 2}} AS collected_at,
       CASE p_partkey % 20 {_setting_case}
            ELSE 'other setting ' || CAST(p_partkey % 20 AS STRING) END AS name,
       CAST(p_size AS BIGINT) AS value,
       CAST(p_size + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS value_in_use,
       (p_partkey % 2 = 0) AS is_advanced, (p_size % 2 = 0) AS is_dynamic
FROM {{part}}""",
    # sys.dm_os_sys_info snapshots.
    "raw_osinfo": """
SELECT CAST(1000 + p_partkey {div} 20 AS INT) AS instance_id,
       {addh:{ts:2024-01-01 00:00:00},p_partkey % 20} AS collected_at,
       CAST(4 * (1 + p_partkey % 8) AS INT) AS cpu_count,
       CAST(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 2 END AS INT) AS hyperthread_ratio,
       CAST((16 + p_partkey % 48) * 1048576 + p_partkey * 37 AS BIGINT) AS physical_memory_kb,
       {mkts:(p_partkey % 50) + CASE WHEN p_partkey % 2 = 0 THEN 0.25 ELSE 0.75 END} AS sqlserver_start_time,
       'SRV' || CAST(1000 + p_partkey {div} 20 AS STRING) AS server_name,
       '16.0.' || CAST(4000 + p_partkey % 100 AS STRING) AS product_version
FROM {part}""",
    # Availability groups (global ids).
    "raw_ag_groups": """
SELECT CAST(r_regionkey AS INT) AS group_id, 'ag_' || lower(replace(r_name, ' ', '_')) AS name FROM {region}""",
    "raw_ag_replicas": f"""
SELECT CAST(1000 + 5 * (s_suppkey {{div}} 5) AS INT) AS instance_id, {SNAP} AS collected_at,
       CAST(s_suppkey AS INT) AS replica_id, CAST(s_nationkey % 5 AS INT) AS group_id,
       'node' || CAST(s_suppkey AS STRING) AS replica_server_name,
       CASE WHEN s_suppkey % 2 = 0 THEN 'SYNCHRONOUS_COMMIT' ELSE 'ASYNCHRONOUS_COMMIT' END AS availability_mode_desc,
       CASE WHEN s_suppkey % 2 = 0 THEN 'AUTOMATIC' ELSE 'MANUAL' END AS failover_mode_desc,
       CASE WHEN s_suppkey % 3 = 0 THEN 'AUTOMATIC' ELSE 'MANUAL' END AS seeding_mode_desc
FROM {{supplier}}""",
    "raw_ag_replica_states": """
SELECT CAST(1000 + 5 * (s_suppkey {div} 5) AS INT) AS instance_id, CAST(s_suppkey AS INT) AS replica_id,
       CASE WHEN s_suppkey % 5 = 0 THEN 'PRIMARY' ELSE 'SECONDARY' END AS role_desc,
       CASE WHEN s_suppkey % 9 = 0 THEN 'OFFLINE' ELSE 'ONLINE' END AS operational_state_desc,
       CASE WHEN s_suppkey % 7 = 0 THEN 'DISCONNECTED' ELSE 'CONNECTED' END AS connected_state_desc,
       'ONLINE' AS recovery_health_desc,
       CASE s_suppkey % 3 WHEN 0 THEN 'HEALTHY' WHEN 1 THEN 'PARTIALLY_HEALTHY' ELSE 'NOT_HEALTHY' END
           AS synchronization_health_desc,
       (s_suppkey % 5 = 0) AS is_local,
       CAST(CASE WHEN s_suppkey % 7 = 0 THEN 35206 END AS INT) AS last_connect_error_number,
       CASE WHEN s_suppkey % 7 = 0 THEN {ts:2024-01-30 12:00:00} END AS last_connect_error_timestamp
FROM {supplier} WHERE s_suppkey % 4 <> 3""",
    "raw_ag_db_states": """
SELECT CAST(1000 + 5 * (p_partkey {div} 100) AS INT) AS instance_id, CAST(p_partkey % 20 AS INT) AS database_id,
       CAST(p_partkey {div} 20 AS INT) AS replica_id, CAST(p_size % 5 AS INT) AS group_id,
       CAST(p_partkey AS BIGINT) AS group_database_id, (p_partkey % 3 <> 0) AS is_local,
       CASE WHEN p_size % 2 = 0 THEN 'SYNCHRONIZED' ELSE 'SYNCHRONIZING' END AS synchronization_state_desc,
       CASE WHEN p_size % 7 = 0 THEN 'NOT_HEALTHY' ELSE 'HEALTHY' END AS synchronization_health_desc,
       (p_partkey % 11 = 0) AS is_suspended,
       CAST(p_size * 10 AS BIGINT) AS log_send_queue_size, CAST(p_size * 3 AS BIGINT) AS redo_queue_size
FROM {part}""",
    "raw_ag_db_cluster_states": """
SELECT CAST(1000 + 5 * (p_partkey {div} 100) AS INT) AS instance_id, CAST(p_partkey {div} 20 AS INT) AS replica_id,
       CAST(p_partkey AS BIGINT) AS group_database_id, (p_size % 3 <> 0) AS is_failover_ready
FROM {part} WHERE p_partkey % 4 <> 0""",
    "raw_cluster": f"""
SELECT instance_id, {SNAP} AS collected_at, 'wsfc_' || instance_fqn AS cluster_name,
       'NODE_MAJORITY' AS quorum_type_desc, 'NORMAL_QUORUM' AS quorum_state_desc
FROM {{instances}} WHERE is_clustered""",
    "raw_cluster_members": f"""
SELECT CAST(1000 + 5 * (s_suppkey {{div}} 5) AS INT) AS instance_id, {SNAP} AS collected_at,
       'node' || CAST(s_suppkey AS STRING) AS member_name, 'CLUSTER_NODE' AS member_type_desc,
       CASE WHEN s_suppkey % 5 = 0 THEN 'DOWN' ELSE 'UP' END AS member_state_desc,
       CAST(s_suppkey % 2 AS INT) AS number_of_quorum_votes
FROM {{supplier}}""",
    "raw_mirroring": f"""
SELECT CAST(1000 + p_partkey {{div}} 20 AS INT) AS instance_id, {SNAP} AS collected_at,
       CAST(p_partkey % 20 AS INT) AS database_id,
       CASE WHEN p_partkey % 9 = 0 THEN 'guid-' || CAST(p_partkey AS STRING) END AS mirroring_guid,
       CASE WHEN p_size % 2 = 0 THEN 'SYNCHRONIZED' ELSE 'SUSPENDED' END AS mirroring_state_desc,
       CASE WHEN p_partkey % 2 = 0 THEN 'PRINCIPAL' ELSE 'MIRROR' END AS mirroring_role_desc,
       CASE WHEN p_size % 3 = 0 THEN 'OFF' ELSE 'FULL' END AS mirroring_safety_level_desc,
       'TCP://node' || CAST(p_partkey % 100 AS STRING) || ':5022' AS mirroring_partner_instance,
       CASE WHEN p_size % 4 = 0 THEN 'TCP://witness:5022' ELSE '' END AS mirroring_witness_name,
       CASE WHEN p_size % 4 = 0 THEN 'CONNECTED' ELSE 'UNKNOWN' END AS mirroring_witness_state_desc,
       CAST(p_size * 100 AS INT) AS mirroring_redo_queue
FROM {{part}}""",
    "raw_trace": f"""
SELECT CAST(1000 + p_partkey {{div}} 20 AS INT) AS instance_id, {SNAP} AS collected_at,
       CAST(p_partkey % 20 AS INT) AS trace_flag, CAST(p_partkey % 2 AS INT) AS status,
       CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS INT) AS global,
       CAST(0 AS INT) AS session
FROM {{part}}""",
}

_collector_case = " ".join(
    f"WHEN {i} THEN '{n}'" for i, n in enumerate((
        "metric_cpu", "metric_memory_ple", "metric_sessions", "metric_database_io", "metric_blocking",
        "databases", "instance_details", "ha_databases", "metric_wait_stats", "metric_perf_counters",
        "config_settings", "trace_flags", "backup_status", "integrity_status", "ha_cluster_members",
        "ha_availability_replicas", "mirroring_health")))

RAW.update({
    # One connection attempt per instance per daily cycle.
    "raw_attempts": """
SELECT instance_id, {dy:ts} AS collected_at, 'tcp:srv' || CAST(instance_id AS STRING) || ',1433' AS connect_target,
       NOT (instance_id % 50 IN (3, 7) AND ts >= {ts:2024-01-28 00:00:00}) AND min(event_id) % 7 <> 3 AS ok,
       CAST(max(event_id) % 900 + 20 AS INT) AS elapsed_ms
FROM {ev} GROUP BY instance_id, {dy:ts}, NOT (instance_id % 50 IN (3, 7) AND ts >= {ts:2024-01-28 00:00:00})""",
    # Result sets returned per (instance, cycle, collector): row count, duration, error text.
    "raw_results": f"""
SELECT instance_id, {{dy:ts}} AS collected_at,
       CASE event_id % 17 {_collector_case} END AS collector_name,
       CAST(event_id % 5 AS INT) AS n_rows, CAST(event_id % 1000 AS INT) AS duration_ms,
       CASE WHEN event_id % 41 = 0 THEN 'Transaction (Process ID ' || CAST(event_id AS STRING) || ') was deadlocked'
            WHEN event_id % 43 = 0 THEN 'Query timeout expired' END AS error_message
FROM {{ev}}""",
    # Landed metric_cpu result rows, values as text (as they arrive), with bad values.
    "raw_landed_cpu": """
SELECT instance_id, {dy:ts} AS collected_at, event_id AS row_id,
       CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 101 = 0 THEN '40000'
            ELSE CAST((event_id * 37) % 90 AS STRING) END AS engine_cpu_percent,
       CASE WHEN event_id % 103 = 0 THEN 'n/a' ELSE CAST((event_id * 17) % 11 AS STRING) END AS other_cpu_percent,
       CAST(100 - (event_id * 37) % 90 - (event_id * 17) % 11 AS STRING) AS system_idle_percent
FROM {ev} WHERE event_type IN ('view', 'click')""",
})

RAW.update({
    # Catalog database counters before/after each benchmark run (cumulative).
    "raw_pg_snapshots": """
SELECT CAST(o_orderkey {div} 1000 AS INT) AS run_id, phase,
       CAST(count(*) AS BIGINT) AS xact_commit,
       CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS xact_rollback,
       CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS tup_inserted,
       CAST(sum(o_custkey % 7) AS BIGINT) AS blks_read, CAST(sum(o_custkey % 113) AS BIGINT) AS blks_hit,
       CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS BIGINT) AS deadlocks,
       CAST(sum((o_orderkey % 4096) * 100) AS BIGINT) AS wal_bytes
FROM (SELECT *, 'after' AS phase FROM {orders}
      UNION ALL SELECT *, 'before' AS phase FROM {orders} WHERE o_orderdate < {ts:1998-06-01 00:00:00}) o
GROUP BY 1, 2""",
    # Activity rows seen by the sampler (one sample per run and hour).
    "raw_activity": """
SELECT CAST(l_orderkey {div} 1000 AS INT) AS run_id, {addh:l_shipdate,l_linenumber} AS sample_at,
       CASE l_returnflag WHEN 'A' THEN 'active' WHEN 'R' THEN 'idle in transaction' ELSE 'idle' END AS state,
       CASE WHEN l_partkey % 5 = 0 THEN 'Lock' END AS wait_event_type,
       CASE WHEN l_linestatus = 'O' THEN CAST(l_suppkey % 600 AS DOUBLE) + 0.125 END AS xact_age_sec
FROM {lineitem}""",
    # Benchmark runs: rows, commits, elapsed seconds, bytes written.
    "raw_runs": """
SELECT run_id, 'M' || CAST(run_id % 4 + 1 AS STRING) AS method, CAST(32 * (1 + run_id % 3) AS INT) AS flush,
       CAST(24 AS INT) AS threads, CAST(CASE WHEN run_id % 2 = 0 THEN 10 ELSE 1000 END AS INT) AS inlining,
       rows_written, commits,
       CASE WHEN run_id = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(mx AS DOUBLE) / 10.0 END AS elapsed_sec, bytes_written
FROM (SELECT CAST(o_orderkey {div} 1000 AS INT) AS run_id, CAST(count(*) AS BIGINT) AS rows_written,
             CAST(count(DISTINCT o_custkey % 64) AS BIGINT) AS commits, max(o_custkey % 1000) AS mx,
             CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes_written
      FROM {orders} GROUP BY 1) r""",
    # Objects under each run's storage prefix.
    "raw_objects": """
SELECT CAST(p_partkey {div} 100 AS INT) AS run_id, 'obj-' || CAST(p_partkey AS STRING) AS object_key,
       CAST(p_size * 1000 AS BIGINT) AS size_bytes
FROM {part}""",
})

_TABLE_REF = re.compile(r"\{([a-z_]+)\}")


def _split_args(s: str) -> list[str]:
    depth, cur, out = 0, "", []
    for ch in s:
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
            continue
        depth += ch == "("
        depth -= ch == ")"
        cur += ch
    out.append(cur)
    return [x.strip() for x in out]


def render(template: str, dialect: str) -> str:
    """Expand placeholders for ``dialect`` ('spark' or 'duckdb'); table refs stay ``{name}``."""
    spark = dialect == "spark"

    def macro(m: re.Match) -> str:
        name, arg = m.group(1), m.group(2)
        if name == "ts":
            return f"TIMESTAMP_NTZ '{arg}'" if spark else f"TIMESTAMP '{arg}'"
        if name == "hr":
            return f"CAST(date_trunc('HOUR', {arg}) AS TIMESTAMP_NTZ)" if spark else f"date_trunc('hour', {arg})"
        if name == "dy":
            return f"CAST(date_trunc('DAY', {arg}) AS TIMESTAMP_NTZ)" if spark else f"date_trunc('day', {arg})"
        if name == "mon":
            return f"CAST(date_trunc('MONTH', {arg}) AS TIMESTAMP_NTZ)" if spark else f"date_trunc('month', {arg})"
        if name == "addh":
            x, n = _split_args(arg)
            return f"timestampadd(HOUR, {n}, {x})" if spark else f"({x} + to_hours(CAST({n} AS BIGINT)))"
        if name == "addd":
            x, n = _split_args(arg)
            return f"timestampadd(DAY, {n}, {x})" if spark else f"({x} + to_days(CAST({n} AS INTEGER)))"
        if name == "mkts":
            return (
                f"make_timestamp_ntz(2023, 12, 1, 0, 0, CAST({arg} AS DECIMAL(8,6)))" if spark
                else f"make_timestamp(2023, 12, 1, 0, 0, CAST({arg} AS DOUBLE))"
            )
        raise KeyError(name)

    out = template.replace("{div}", "div" if spark else "//")
    macro_re = re.compile(r"\{(ts|hr|dy|mon|addh|addd|mkts):([^{}]*)\}")
    while True:
        new = macro_re.sub(macro, out)
        if new == out:
            break
        out = new
    if not spark:
        out = out.replace(" AS STRING)", " AS VARCHAR)")
        out = _TABLE_REF.sub(lambda m: m.group(1), out)
    return out


def referenced_tables(sql: str) -> list[str]:
    return sorted(set(_TABLE_REF.findall(sql)))


class RawSnapshots:
    """Spark side: raw snapshot DataFrames for one input folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, lake=None):
        from fleetpulse.sources.derived import DerivedLake

        self.spark = spark
        self.sf_dir = sf_dir
        self.lake = lake or DerivedLake(spark, sf_dir)
        self._cache: dict[str, DataFrame] = {}

    def _ref(self, name: str) -> DataFrame:
        if name in RAW:
            return self.table(name)
        if hasattr(type(self.lake), name):
            return self.lake.table(name)
        return self.lake.base(name)

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            sql = render(RAW[name], "spark")
            args = {t: self._ref(t) for t in referenced_tables(sql)}
            self._cache[name] = self.spark.sql(sql, **args)
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("raw_"):
            return self.table(name)
        raise AttributeError(name)


def register_oracle() -> None:
    from fleetpulse.checks.oracle import register

    for name, tpl in RAW.items():
        register(name, render(tpl, "duckdb"))
