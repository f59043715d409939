"""Registered base operators (filters, joins, aggregates, windows, sorts, set ops,
scalar functions), each on the derived lake or raw snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

import fleetpulse.catalog.packs  # noqa: F401  (raw oracle CTEs)
from fleetpulse import schemas as S
from fleetpulse.catalog import register
from fleetpulse.functions import scalar as X
from fleetpulse.operators import joins as J
from fleetpulse.operators.windows import chunk_ids, latest_per_key_rownum, topn_per_group
from fleetpulse.plans import scoring as V
from fleetpulse.sources.derived import AS_OF, DerivedLake
from fleetpulse.sources.raw import BENIGN_WAITS, RawSnapshots

IN_BENIGN = ", ".join(f"'{w}'" for w in BENIGN_WAITS)


def lake(spark, sf_dir) -> DerivedLake:
    return DerivedLake(spark, sf_dir)


def raw(spark, sf_dir) -> RawSnapshots:
    return RawSnapshots(spark, sf_dir)


# ------------------------------------------------------------------ P rows
@register("eligible_filter", """
SELECT d.instance_id, d.database_id, d.database_name, d.collected_at
FROM databases d JOIN instances i USING (instance_id)
WHERE i.status IN ('a', 'b') AND i.environment = 'P' AND d.database_id > 4
  AND d.database_name NOT IN ('master', 'tempdb', 'model', 'msdb', 'uhtdba')""")
def q_eligible_filter(spark, sf_dir):
    """P4 over every database snapshot."""
    lk = lake(spark, sf_dir)
    j = lk.databases.join(lk.instances.select("instance_id", "status", "environment"), "instance_id")
    return V.eligible_filter(j).select("instance_id", "database_id", "database_name", "collected_at")


@register("not_null_filter", """
SELECT instance_id, collected_at, page_residency_seconds FROM metric_memory
WHERE page_residency_seconds IS NOT NULL""")
def q_not_null_filter(spark, sf_dir):
    """P5."""
    m = lake(spark, sf_dir).metric_memory
    return m.filter(F.col("page_residency_seconds").isNotNull()).select(
        "instance_id", "collected_at", "page_residency_seconds")


@register("restart_hour_filter", """
SELECT instance_id, database_id, collected_at, last_restart_at FROM metric_database_io
WHERE last_restart_at IS NOT NULL AND date_trunc('hour', collected_at) <> date_trunc('hour', last_restart_at)""")
def q_restart_hour_filter(spark, sf_dir):
    """P6."""
    return V.restart_hour_filter(lake(spark, sf_dir).metric_database_io).select(
        "instance_id", "database_id", "collected_at", "last_restart_at")


@register("closed_hours", """
SELECT * FROM o_cpu_hourly WHERE coll_hr < date_trunc('hour', TIMESTAMP '2024-01-20 12:34:56')""")
def q_closed_hours(spark, sf_dir):
    """P7 with an as-of inside the data: the still-filling hour and later are dropped."""
    as_of = "2024-01-20 12:34:56"
    return V.cpu_hourly(lake(spark, sf_dir).metric_cpu, as_of).filter(
        F.col("coll_hr") < V.closed_hour_cut(as_of))


@register("time_range", "SELECT * FROM o_ping_window")
def q_time_range(spark, sf_dir):
    """Strict trailing 28-day range."""
    return V.ping_window(lake(spark, sf_dir).pings, AS_OF)


@register("responsive_only", """
SELECT c.instance_id, c.collected_at, c.engine_cpu_percent FROM metric_cpu c
WHERE EXISTS (SELECT 1 FROM pings p WHERE p.is_success AND p.instance_id = c.instance_id
              AND date_trunc('hour', p.collected_at) = date_trunc('hour', c.collected_at))""")
def q_responsive_only(spark, sf_dir):
    """P10: only rows of cycles (instance-hours) whose ping succeeded (left semi join)."""
    lk = lake(spark, sf_dir)
    ok = lk.pings.filter("is_success").select("instance_id", X.hour_bucket("collected_at").alias("hr"))
    cpu = lk.metric_cpu.select("instance_id", "collected_at", "engine_cpu_percent",
                               X.hour_bucket("collected_at").alias("hr"))
    return J.semi(cpu, ok, ["instance_id", "hr"]).drop("hr")


@register("try_cast_project", """
SELECT instance_id, coll_hr, TRY_CAST(avg_engine_cpu AS SMALLINT) AS sql_cpu,
       TRY_CAST(avg_engine_cpu * 4 AS TINYINT) AS cpu_x4_tiny, TRY_CAST(avg_idle_cpu AS SMALLINT) AS idl_cpu
FROM o_cpu_hourly""")
def q_try_cast_project(spark, sf_dir):
    """NULL-on-overflow narrowing with half-to-even rounding (values > 127 become NULL)."""
    h = V.cpu_hourly(lake(spark, sf_dir).metric_cpu)
    return h.select(
        "instance_id", "coll_hr",
        X.round_half_even_cast("avg_engine_cpu", "smallint").alias("sql_cpu"),
        X.round_half_even_cast(F.col("avg_engine_cpu") * 4, "tinyint").alias("cpu_x4_tiny"),
        X.round_half_even_cast("avg_idle_cpu", "smallint").alias("idl_cpu"),
    )


@register("null_flag", """
SELECT i.instance_id, (u.instance_id IS NOT NULL) AS is_unresponsive
FROM instances i LEFT JOIN o_unresponsive u USING (instance_id)""")
def q_null_flag(spark, sf_dir):
    """``(x IS NOT NULL) AS flag`` after a left join."""
    lk = lake(spark, sf_dir)
    u = V.unresponsive(lk, AS_OF).select("instance_id", F.lit(1).alias("_u"))
    return lk.instances.select("instance_id").join(u, "instance_id", "left").select(
        "instance_id", F.col("_u").isNotNull().alias("is_unresponsive"))


# ------------------------------------------------------------------ J rows
@register("dim_inner_join", """
SELECT s.instance_id, i.instance_fqn, s.collected_at, s.active_sessions
FROM metric_sessions s JOIN instances i ON i.instance_id = s.instance_id""")
def q_dim_inner_join(spark, sf_dir):
    """Fact x dimension on instance_id (dimension broadcast when under the size threshold)."""
    lk = lake(spark, sf_dir)
    return lk.metric_sessions.join(lk.instances.select("instance_id", "instance_fqn"), "instance_id").select(
        "instance_id", "instance_fqn", "collected_at", "active_sessions")


@register("fanout_join", """
SELECT c.instance_id, e.database_id, c.coll_hr, c.avg_engine_cpu
FROM o_cpu_hourly c JOIN o_eligible e ON e.instance_id = c.instance_id""")
def q_fanout_join(spark, sf_dir):
    """An instance-hour row multiplied over the instance's eligible databases (1:N)."""
    lk = lake(spark, sf_dir)
    ed = V.eligible_databases(lk.databases, lk.instances).select("instance_id", "database_id")
    return V.cpu_hourly(lk.metric_cpu).join(ed, "instance_id").select(
        "instance_id", "database_id", "coll_hr", "avg_engine_cpu")


@register("left_multi_key_join", """
SELECT instance_id, database_id, coll_hr, avg_ple_sec, avg_active_sessions, read_latency_ms,
       write_latency_ms, max_blocking_sessions FROM o_health_base""")
def q_left_multi_key_join(spark, sf_dir):
    """Four left joins on (instance[, database], hour)."""
    return V.health_base(lake(spark, sf_dir), AS_OF).select(
        "instance_id", "database_id", "coll_hr", "avg_ple_sec", "avg_active_sessions",
        "read_latency_ms", "write_latency_ms", "max_blocking_sessions")


@register("threshold_cross_join", """
SELECT b.instance_id, b.database_id, b.coll_hr, b.cpu_busy_pct, t.cpu_dir, t.cpu_warn, t.cpu_crit
FROM o_health_base b, o_th t""")
def q_threshold_cross_join(spark, sf_dir):
    """Every row paired with the one-row pivoted rule table (as a scalar subquery)."""
    lk = lake(spark, sf_dir)
    th = V.threshold_scalars(lk.score_thresholds)
    return V.health_base(lk, AS_OF).select(
        "instance_id", "database_id", "coll_hr", "cpu_busy_pct",
        th["cpu_dir"].alias("cpu_dir"), th["cpu_warn"].alias("cpu_warn"), th["cpu_crit"].alias("cpu_crit"))


@register("after_event_join", """
SELECT p.instance_id, p.collected_at, l.last_success_at
FROM o_ping_window p JOIN o_last_success l USING (instance_id)
WHERE NOT p.is_success AND p.collected_at > l.last_success_at""")
def q_after_event_join(spark, sf_dir):
    """Equi join + inequality residual (failures after the last success)."""
    lk = lake(spark, sf_dir)
    fails = V.ping_window(lk.pings, AS_OF).filter(~F.col("is_success"))
    return J.after_event(fails, V.last_success(lk.pings, AS_OF), "instance_id", "collected_at",
                         "last_success_at").select("instance_id", "collected_at", "last_success_at")


@register("flag_left_join", """
SELECT i.instance_id, (u.instance_id IS NOT NULL) AS is_unresponsive, (h.instance_id IS NOT NULL) AS is_high_irc,
       CAST(coalesce(h.irc_index, 0) AS TINYINT) AS irc_index
FROM instances i LEFT JOIN o_unresponsive u USING (instance_id) LEFT JOIN o_high_irc h USING (instance_id)""")
def q_flag_left_join(spark, sf_dir):
    """Two optional populations left-joined onto the key set, flagged."""
    lk = lake(spark, sf_dir)
    return J.flag_left_join(
        lk.instances.select("instance_id"),
        {"is_unresponsive": V.unresponsive(lk, AS_OF).select("instance_id"),
         "is_high_irc": V.high_irc(lk, AS_OF).select("instance_id", "irc_index")},
        "instance_id",
    ).select("instance_id", "is_unresponsive", "is_high_irc",
             F.coalesce("irc_index", F.lit(0).cast("tinyint")).alias("irc_index"))


@register("insert_if_absent", """
SELECT DISTINCT b.* FROM (
  SELECT * FROM pings WHERE day >= 20 UNION ALL SELECT * FROM pings WHERE day >= 28) b
WHERE NOT EXISTS (SELECT 1 FROM pings t WHERE t.day < 25 AND t.instance_id = b.instance_id
                  AND t.collected_at = b.collected_at)""")
def q_insert_if_absent(spark, sf_dir):
    """The rows an idempotent append would add (batch de-duplicated, anti-joined on the key)."""
    p = lake(spark, sf_dir).pings
    batch = p.filter(F.col("day") >= 20).unionByName(p.filter(F.col("day") >= 28))
    target = p.filter(F.col("day") < 25)
    return J.insert_if_absent(batch, target, ["instance_id", "collected_at"], S.HOT_PARTITIONS)


_J9_SRC = """(SELECT CAST(1000 + s_suppkey AS INTEGER) AS instance_id, upper(s_name) AS instance_fqn,
        'sqlserver' AS platform, 'integrated' AS auth_mode, TIMESTAMP '2024-01-15 00:00:00' AS registered_at
 FROM supplier WHERE s_suppkey % 2 = 1)"""


@register("replace_by_key", f"""
SELECT instance_id, instance_fqn, instance_name, platform, environment, status, auth_mode, registered_at
FROM instances WHERE instance_id NOT IN (SELECT instance_id FROM {_J9_SRC})
UNION ALL
SELECT instance_id, instance_fqn, CAST(NULL AS VARCHAR), platform, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR),
       auth_mode, registered_at FROM {_J9_SRC}""")
def q_replace_by_key(spark, sf_dir):
    """Delete target rows whose key is in the source, insert all source rows (missing columns NULL)."""
    lk = lake(spark, sf_dir)
    s = lk.base("supplier").filter(F.col("s_suppkey") % 2 == 1).select(
        (F.lit(1000) + F.col("s_suppkey")).cast("int").alias("instance_id"),
        F.upper("s_name").alias("instance_fqn"), F.lit("sqlserver").alias("platform"),
        F.lit("integrated").alias("auth_mode"), X.ts_lit("2024-01-15 00:00:00").alias("registered_at"))
    out = J.replace_by_key(lk.instances, s, ["instance_id"])
    return out.select("instance_id", "instance_fqn", "instance_name", "platform", "environment", "status",
                      "auth_mode", "registered_at")


@register("lateral_top1", """
SELECT instance_id, database_name, backup_size, compressed_backup_size FROM raw_backupset WHERE type = 'D'
QUALIFY row_number() OVER (PARTITION BY instance_id, database_name
        ORDER BY backup_finish_date DESC, backup_size DESC, compressed_backup_size DESC) = 1""")
def q_lateral_top1(spark, sf_dir):
    """``OUTER APPLY (TOP 1 .. ORDER BY .. DESC)`` as max_by per key (map-side combined)."""
    from fleetpulse.operators.windows import latest_per_key

    bs = raw(spark, sf_dir).raw_backupset.filter(F.col("type") == "D")
    return latest_per_key(bs, ["instance_id", "database_name"], ["backup_finish_date"],
                          ["backup_size", "compressed_backup_size"],
                          columns=["instance_id", "database_name", "backup_size", "compressed_backup_size"])


@register("scalar_subquery_join", """
SELECT DISTINCT c.instance_id, c.collected_at, t.create_date AS last_restart_at
FROM raw_counters c LEFT JOIN raw_tempdb t USING (instance_id)""")
def q_scalar_subquery_join(spark, sf_dir):
    """A per-instance scalar (tempdb create date) projected onto each snapshot."""
    r = raw(spark, sf_dir)
    snaps = r.raw_counters.select("instance_id", "collected_at").distinct()
    return snaps.join(r.raw_tempdb.select("instance_id", F.col("create_date").alias("last_restart_at")),
                      "instance_id", "left")


@register("correlated_count", """
SELECT d.instance_id, d.database_id, coalesce(s.n, 0) AS suspect_page_count
FROM raw_sysdb d LEFT JOIN (SELECT instance_id, database_id, count(*) AS n FROM raw_suspect GROUP BY ALL) s
  USING (instance_id, database_id)""")
def q_correlated_count(spark, sf_dir):
    """Correlated COUNT(*) as pre-aggregate + left join + coalesce 0."""
    r = raw(spark, sf_dir)
    return J.count_per_key(r.raw_sysdb.select("instance_id", "database_id"), r.raw_suspect,
                           ["instance_id", "database_id"], "suspect_page_count")


@register("self_dim_double_join", """
SELECT instance_id, database_id,
       sum(CASE WHEN type = 0 THEN CAST(size AS DOUBLE) * 8.0 / 1024 END) AS data_mb,
       sum(CASE WHEN type = 1 THEN CAST(size AS DOUBLE) * 8.0 / 1024 END) AS log_mb
FROM raw_files GROUP BY ALL""")
def q_self_dim_double_join(spark, sf_dir):
    """One aggregate read twice with different filters, collapsed to conditional sums."""
    f = raw(spark, sf_dir).raw_files
    mb = F.col("size").cast("double") * 8.0 / 1024
    return f.groupBy("instance_id", "database_id").agg(
        F.sum(F.when(F.col("type") == 0, mb)).alias("data_mb"),
        F.sum(F.when(F.col("type") == 1, mb)).alias("log_mb"))


# ------------------------------------------------------------------ A rows
@register("hourly_avg", "SELECT * FROM o_sessions_hourly")
def q_hourly_avg(spark, sf_dir):
    """A1 (sessions)."""
    return V.sessions_hourly(lake(spark, sf_dir).metric_sessions)


@register("hourly_avg_counters", "SELECT * FROM o_io_bucketed")
def q_hourly_avg_counters(spark, sf_dir):
    """A2."""
    return V.io_bucketed(lake(spark, sf_dir).metric_database_io)


@register("hourly_max", "SELECT * FROM o_blocking_hourly")
def q_hourly_max(spark, sf_dir):
    """A3."""
    return V.blocking_hourly(lake(spark, sf_dir).metric_blocking)


@register("worst_rollup", "SELECT * FROM o_health_instance")
def q_worst_rollup(spark, sf_dir):
    """A5."""
    return V.health_scores_instance(lake(spark, sf_dir), AS_OF)


@register("key_range", """
SELECT platform, count(*) AS n, min(instance_id) AS min_id, max(instance_id) AS max_id FROM instances GROUP BY ALL""")
def q_key_range(spark, sf_dir):
    """A11."""
    return lake(spark, sf_dir).instances.groupBy("platform").agg(
        F.count(F.lit(1)).alias("n"), F.min("instance_id").alias("min_id"), F.max("instance_id").alias("max_id"))


@register("group_sum_filtered", """
SELECT f.instance_id, f.database_id, CAST(sum(v.num_of_reads) AS BIGINT) AS num_of_reads,
       CAST(sum(v.io_stall_read_ms) AS BIGINT) AS io_stall_read_ms
FROM raw_files f
JOIN raw_vfs v ON v.instance_id = f.instance_id AND v.database_id = f.database_id AND v.file_id = f.file_id
JOIN raw_sysdb d ON d.instance_id = f.instance_id AND d.database_id = f.database_id
WHERE f.type_desc <> 'FULLTEXT' AND d.state_desc = 'ONLINE' GROUP BY ALL""")
def q_group_sum_filtered(spark, sf_dir):
    """Sums after inner joins and filters."""
    from fleetpulse.plans.packs import database_io_totals

    return database_io_totals(raw(spark, sf_dir)).select(
        "instance_id", "database_id", "num_of_reads", "io_stall_read_ms")


@register("group_count_filtered", """
SELECT instance_id, collected_at, database_id, CAST(count(*) AS INTEGER) AS blocked_session_count
FROM raw_requests WHERE blocking_session_id <> 0 AND database_id > 0 GROUP BY ALL""")
def q_group_count_filtered(spark, sf_dir):
    """Grouped count, no row when zero."""
    from fleetpulse.plans.packs import blocking_counts

    return blocking_counts(raw(spark, sf_dir)).select(
        "instance_id", "collected_at", "database_id", "blocked_session_count")


@register("avg_having_nonempty", """
SELECT instance_id, collected_at, avg(sql_util) AS avg_util FROM (
  SELECT instance_id, collected_at,
         CAST(regexp_extract(record, '<ProcessUtilization>([0-9]+)</ProcessUtilization>', 1) AS INTEGER) AS sql_util
  FROM raw_ring WHERE record LIKE '%<SystemHealth>%') r
GROUP BY ALL HAVING count(*) > 0""")
def q_avg_having_nonempty(spark, sf_dir):
    """A per-snapshot aggregate that yields no row for an empty snapshot."""
    from fleetpulse.plans.packs import ring_records

    return ring_records(raw(spark, sf_dir)).groupBy("instance_id", "collected_at").agg(
        F.avg("sql_util").alias("avg_util"))


@register("latest_by_type", """
SELECT instance_id, database_name,
       max(CASE WHEN type = 'D' THEN backup_finish_date END) AS last_full_backup,
       max(CASE WHEN type = 'I' THEN backup_finish_date END) AS last_diff_backup,
       max(CASE WHEN type = 'L' THEN backup_finish_date END) AS last_log_backup
FROM raw_backupset GROUP BY ALL""")
def q_latest_by_type(spark, sf_dir):
    """A16."""
    bs = raw(spark, sf_dir).raw_backupset
    when = lambda t: F.max(F.when(F.col("type") == t, F.col("backup_finish_date")))
    return bs.groupBy("instance_id", "database_name").agg(
        when("D").alias("last_full_backup"), when("I").alias("last_diff_backup"),
        when("L").alias("last_log_backup"))


# ------------------------------------------------------------------ W rows
@register("latest_per_key", """
SELECT instance_id, collected_at, active_sessions FROM metric_sessions
QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY collected_at DESC, active_sessions DESC) = 1""")
def q_latest_per_key(spark, sf_dir):
    """W1 in its literal window form (row_number per key = 1)."""
    s = lake(spark, sf_dir).metric_sessions.select("instance_id", "collected_at", "active_sessions")
    return latest_per_key_rownum(s, ["instance_id"], [F.col("collected_at").desc(),
                                                      F.col("active_sessions").desc()])


@register("lag_default", "SELECT * FROM o_io_lagged")
def q_lag_default(spark, sf_dir):
    """W2."""
    return V.io_lagged(lake(spark, sf_dir).metric_database_io)


@register("reset_guarded_delta", "SELECT * FROM o_io_deltas")
def q_reset_guarded_delta(spark, sf_dir):
    """W3."""
    return V.io_deltas(lake(spark, sf_dir).metric_database_io)


@register("all_lags_present", """
SELECT instance_id, database_id, coll_hr FROM o_io_lagged
WHERE lag_num_of_reads <> 0 AND lag_io_wait_read_ms <> 0 AND lag_num_of_writes <> 0 AND lag_io_wait_write_ms <> 0""")
def q_all_lags_present(spark, sf_dir):
    """W4."""
    from fleetpulse.operators.windows import all_nonzero

    lagged = V.io_lagged(lake(spark, sf_dir).metric_database_io)
    return lagged.filter(all_nonzero([f"lag_{c}" for c in V.IO_NAMES])).select(
        "instance_id", "database_id", "coll_hr")


@register("per_op_latency", "SELECT * FROM o_io_latency")
def q_per_op_latency(spark, sf_dir):
    """W5."""
    return V.io_latency_hourly(lake(spark, sf_dir).metric_database_io)


@register("topn_per_group", """
SELECT instance_id, collected_at, wait_type, wait_time_ms,
       row_number() OVER (PARTITION BY instance_id, collected_at ORDER BY wait_time_ms DESC, wait_type) AS rank
FROM raw_waits
QUALIFY rank <= 25""")
def q_topn_per_group(spark, sf_dir):
    """TOP 25 per snapshot with a deterministic tiebreak."""
    w = raw(spark, sf_dir).raw_waits.select("instance_id", "collected_at", "wait_type", "wait_time_ms")
    return topn_per_group(w, ["instance_id", "collected_at"],
                          [F.col("wait_time_ms").desc(), F.col("wait_type").asc()], 25, rank_col="rank")


@register("flush_chunks", """
SELECT instance_id, collected_at,
       CAST((row_number() OVER (ORDER BY collected_at, instance_id) - 1) // 32 AS BIGINT) AS chunk_id
FROM raw_cycles""")
def q_flush_chunks(spark, sf_dir):
    """Consecutive chunks of 32 over the ordered cycles, via per-partition offsets."""
    c = raw(spark, sf_dir).raw_cycles
    return chunk_ids(c, ["collected_at", "instance_id"], 32).select("instance_id", "collected_at", "chunk_id")


# ------------------------------------------------------------------ O rows
@register("offline_now", """
SELECT instance_id, collected_at, response_time_ms FROM pings WHERE NOT is_success""")
def q_offline_now(spark, sf_dir):
    """Failed pings, newest first."""
    p = lake(spark, sf_dir).pings
    return p.filter(~F.col("is_success")).select("instance_id", "collected_at", "response_time_ms").orderBy(
        F.col("collected_at").desc(), "instance_id")


@register("ordered_snapshot", """
SELECT instance_id, collected_at, trace_flag, (status <> 0) AS is_enabled, (global <> 0) AS is_global
FROM raw_trace WHERE global = 1""")
def q_ordered_snapshot(spark, sf_dir):
    """Snapshot ordered by instance and flag number."""
    from fleetpulse.plans.packs import trace_flags

    return trace_flags(raw(spark, sf_dir))


# ------------------------------------------------------------------ U rows
@register("union_all_branches", """
SELECT instance_id, collected_at, active_sessions, 'sessions_table' AS branch FROM metric_sessions
UNION ALL
SELECT c.instance_id, c.collected_at, CAST(coalesce(s.n, 0) AS INTEGER), 'raw_snapshot'
FROM raw_cycles c LEFT JOIN (SELECT instance_id, collected_at,
       count(*) FILTER (WHERE login_name <> 'sa' AND is_user_process) AS n FROM raw_sessions GROUP BY ALL) s
  USING (instance_id, collected_at)""")
def q_union_all_branches(spark, sf_dir):
    """UNION ALL of landings with the source stamped per branch (by name)."""
    from fleetpulse.plans.packs import active_sessions

    a = lake(spark, sf_dir).metric_sessions.select("instance_id", "collected_at", "active_sessions",
                                                    F.lit("sessions_table").alias("branch"))
    b = active_sessions(raw(spark, sf_dir)).select("instance_id", "collected_at", "active_sessions",
                                                   F.lit("raw_snapshot").alias("branch"))
    return a.unionByName(b)


@register("distinct_instances", "SELECT DISTINCT instance_id FROM pings WHERE is_success")
def q_distinct_instances(spark, sf_dir):
    """U3."""
    return lake(spark, sf_dir).pings.filter("is_success").select("instance_id").distinct()


# ------------------------------------------------------------------ F rows
@register("hour_bucket", "SELECT instance_id, collected_at, date_trunc('hour', collected_at) AS coll_hr FROM metric_cpu")
def q_hour_bucket(spark, sf_dir):
    """F1."""
    return lake(spark, sf_dir).metric_cpu.select("instance_id", "collected_at",
                                                 X.hour_bucket("collected_at").alias("coll_hr"))


@register("utc_now", """
SELECT instance_id, (registered_at < CAST(now() AT TIME ZONE 'UTC' AS TIMESTAMP)) AS registered_before_now
FROM instances""")
def q_utc_now(spark, sf_dir):
    """compare to the current UTC instant (session zone UTC)."""
    return lake(spark, sf_dir).instances.select(
        "instance_id", (F.col("registered_at") < X.utc_now()).alias("registered_before_now"))


@register("year_month", """
SELECT DISTINCT coll_hr, CAST(year(coll_hr) AS SMALLINT) AS year, CAST(month(coll_hr) AS TINYINT) AS month
FROM o_cpu_hourly""")
def q_year_month(spark, sf_dir):
    """F3."""
    h = V.cpu_hourly(lake(spark, sf_dir).metric_cpu)
    return h.select("coll_hr", X.year_s("coll_hr").alias("year"), X.month_t("coll_hr").alias("month")).distinct()


@register("interval_arith", """
SELECT instance_id, collected_at, collected_at - INTERVAL 4 DAY AS minus_4d,
       collected_at - INTERVAL 720 HOUR AS minus_720h FROM pings""")
def q_interval_arith(spark, sf_dir):
    """F4."""
    p = lake(spark, sf_dir).pings
    return p.select("instance_id", "collected_at", X.minus_days("collected_at", 4).alias("minus_4d"),
                    X.minus_hours("collected_at", 720).alias("minus_720h"))


@register("coalesce_zero", """
SELECT e.instance_id, e.database_id, CAST(coalesce(b.n, 0) AS BIGINT) AS blocking_rows
FROM o_eligible e LEFT JOIN (SELECT instance_id, database_id, count(*) AS n FROM metric_blocking GROUP BY ALL) b
  USING (instance_id, database_id)""")
def q_coalesce_zero(spark, sf_dir):
    """F5."""
    lk = lake(spark, sf_dir)
    ed = V.eligible_databases(lk.databases, lk.instances).select("instance_id", "database_id")
    n = lk.metric_blocking.groupBy("instance_id", "database_id").agg(F.count(F.lit(1)).alias("n"))
    return ed.join(n, ["instance_id", "database_id"], "left").select(
        "instance_id", "database_id", X.coalesce_zero("n").cast("bigint").alias("blocking_rows"))


@register("nullif_div", """
SELECT instance_id, database_id, coll_hr, io_wait_read_ms / NULLIF(num_of_reads, 0) AS ms_per_read
FROM o_io_deltas""")
def q_nullif_div(spark, sf_dir):
    """division guarded by NULLIF (a zero divisor gives NULL, not an error)."""
    d = V.io_deltas(lake(spark, sf_dir).metric_database_io)
    return d.select("instance_id", "database_id", "coll_hr",
                    X.safe_div("io_wait_read_ms", "num_of_reads").alias("ms_per_read"))


@register("floor_ratio", """
SELECT instance_id, database_id, coll_hr,
       CAST(floor(io_wait_write_ms / NULLIF(num_of_writes, 0)) AS BIGINT) AS ms_per_write FROM o_io_deltas""")
def q_floor_ratio(spark, sf_dir):
    """F7."""
    d = V.io_deltas(lake(spark, sf_dir).metric_database_io)
    return d.select("instance_id", "database_id", "coll_hr",
                    X.floor_ratio("io_wait_write_ms", "num_of_writes").alias("ms_per_write"))


@register("band_index", """
SELECT instance_id, coll_hr,
  CAST(CASE WHEN avg_engine_cpu + avg_other_cpu IS NULL THEN 0
            WHEN avg_engine_cpu + avg_other_cpu < 75 THEN 0 WHEN avg_engine_cpu + avg_other_cpu < 90 THEN 1
            ELSE 2 END AS TINYINT) AS cpu_band,
  CAST(CASE WHEN avg_engine_cpu IS NULL THEN 0 WHEN avg_engine_cpu >= 60 THEN 0
            WHEN avg_engine_cpu >= 30 THEN 1 ELSE 2 END AS TINYINT) AS lower_band,
  CAST(CASE WHEN avg_engine_cpu IS NULL THEN 0 WHEN NULL >= 1 THEN 0 ELSE 2 END AS TINYINT) AS missing_rule_band
FROM o_cpu_hourly""")
def q_band_index(spark, sf_dir):
    """F8: higher_worse, lower_worse and a missing rule (NULL thresholds fall through to 2)."""
    h = V.cpu_hourly(lake(spark, sf_dir).metric_cpu)
    busy = F.col("avg_engine_cpu") + F.col("avg_other_cpu")
    null = F.lit(None).cast("double")
    return h.select(
        "instance_id", "coll_hr",
        X.band_index(busy, F.lit("higher_worse"), F.lit(75.0), F.lit(90.0)).alias("cpu_band"),
        X.band_index("avg_engine_cpu", F.lit("lower_worse"), F.lit(60.0), F.lit(30.0)).alias("lower_band"),
        X.band_index("avg_engine_cpu", F.lit(None).cast("string"), null, null).alias("missing_rule_band"),
    )


@register("cast_try_cast", """
SELECT instance_id, collected_at, CAST(engine_cpu_percent AS INTEGER) AS engine_int,
       TRY_CAST(engine_cpu_percent * 3 AS TINYINT) AS engine_x3_tiny
FROM metric_cpu""")
def q_cast_try_cast(spark, sf_dir):
    """widening CAST and NULL-on-overflow TRY_CAST."""
    c = lake(spark, sf_dir).metric_cpu
    return c.select("instance_id", "collected_at", F.col("engine_cpu_percent").cast("int").alias("engine_int"),
                    (F.col("engine_cpu_percent") * 3).try_cast("tinyint").alias("engine_x3_tiny"))


@register("membership", f"""
SELECT instance_id, collected_at, wait_type, (wait_type IN ({IN_BENIGN})) AS is_benign FROM raw_waits""")
def q_membership(spark, sf_dir):
    """IN over the 80-name list (planned as a hash set, stays in codegen)."""
    w = raw(spark, sf_dir).raw_waits
    return w.select("instance_id", "collected_at", "wait_type",
                    F.col("wait_type").isin(*BENIGN_WAITS).alias("is_benign"))


@register("like_trim", """
SELECT instance_id, collected_at, object_name, counter_name,
       (rtrim(object_name) LIKE '%:SQL Statistics') AS is_sql_stats,
       (object_name LIKE '%Buffer Manager%') AS is_buffer_manager
FROM raw_counters""")
def q_like_trim(spark, sf_dir):
    """F11."""
    c = raw(spark, sf_dir).raw_counters
    return c.select("instance_id", "collected_at", "object_name", "counter_name",
                    F.rtrim("object_name").like("%:SQL Statistics").alias("is_sql_stats"),
                    F.col("object_name").like("%Buffer Manager%").alias("is_buffer_manager"))


@register("clamp_zero", """
SELECT instance_id, collected_at, record_id,
       CASE WHEN 100 - system_idle - sql_util * 2 < 0 THEN 0 ELSE 100 - system_idle - sql_util * 2 END AS other
FROM (SELECT instance_id, collected_at,
        CAST(regexp_extract(record, '<SystemIdle>([0-9]+)</SystemIdle>', 1) AS INTEGER) AS system_idle,
        CAST(regexp_extract(record, '<ProcessUtilization>([0-9]+)</ProcessUtilization>', 1) AS INTEGER) AS sql_util,
        CAST(regexp_extract(record, '<Record id="([0-9]+)"', 1) AS INTEGER) AS record_id
      FROM raw_ring WHERE record LIKE '%<SystemHealth>%') r""")
def q_clamp_zero(spark, sf_dir):
    """F13."""
    from fleetpulse.plans.packs import ring_records

    r = ring_records(raw(spark, sf_dir))
    return r.select("instance_id", "collected_at", "record_id",
                    X.clamp_zero(F.lit(100) - F.col("system_idle") - F.col("sql_util") * 2).alias("other"))


@register("int_division", """
SELECT instance_id, collected_at, CAST(cpu_count // NULLIF(hyperthread_ratio, 0) AS INTEGER) AS physical_cpus,
       CAST(physical_memory_kb // 1024 AS BIGINT) AS physical_memory_mb FROM raw_osinfo""")
def q_int_division(spark, sf_dir):
    """integer division truncates."""
    o = raw(spark, sf_dir).raw_osinfo
    return o.select("instance_id", "collected_at",
                    F.expr("cpu_count div nullif(hyperthread_ratio, 0)").cast("int").alias("physical_cpus"),
                    F.expr("physical_memory_kb div 1024").alias("physical_memory_mb"))


@register("flag_from_null", """
SELECT instance_id, database_id, (group_database_id IS NOT NULL) AS is_alwayson FROM raw_sysdb""")
def q_flag_from_null(spark, sf_dir):
    """F15."""
    d = raw(spark, sf_dir).raw_sysdb
    return d.select("instance_id", "database_id", F.col("group_database_id").isNotNull().alias("is_alwayson"))


@register("neq_flag", """
SELECT instance_id, collected_at, name, coalesce(value <> value_in_use, FALSE) AS is_pending FROM raw_config""")
def q_neq_flag(spark, sf_dir):
    """F16."""
    c = raw(spark, sf_dir).raw_config
    return c.select("instance_id", "collected_at", "name", X.neq_flag("value", "value_in_use").alias("is_pending"))


@register("concat_label", """
SELECT instance_id, 'bench-' || CAST(instance_id - 1000 AS VARCHAR) AS bench_label,
       coalesce(instance_name, instance_fqn) AS display_name FROM instances""")
def q_concat_label(spark, sf_dir):
    """F17."""
    i = lake(spark, sf_dir).instances
    return i.select("instance_id",
                    F.concat(F.lit("bench-"), (F.col("instance_id") - 1000).cast("string")).alias("bench_label"),
                    F.coalesce("instance_name", "instance_fqn").alias("display_name"))


@register("format_round", """
SELECT instance_id, database_id, coll_hr, strftime(coll_hr, '%H:%M') AS hr, round(blocker_ratio, 3) AS ratio
FROM o_health_scores""")
def q_format_round(spark, sf_dir):
    """F18."""
    hs = V.health_scores(lake(spark, sf_dir), AS_OF)
    return hs.select("instance_id", "database_id", "coll_hr", F.date_format("coll_hr", "HH:mm").alias("hr"),
                     F.round("blocker_ratio", 3).alias("ratio"))


@register("epoch_diff", """
SELECT instance_id, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(last_success_at)) / 1e6 AS seconds_since_success
FROM o_last_success""")
def q_epoch_diff(spark, sf_dir):
    """seconds elapsed between two instants."""
    ls = V.last_success(lake(spark, sf_dir).pings, AS_OF)
    return ls.select("instance_id", X.epoch_seconds_between(V.as_of_col(AS_OF), "last_success_at")
                     .alias("seconds_since_success"))


@register("second_precision", """
SELECT instance_id, collected_at,
       date_trunc('second', sqlserver_start_time + INTERVAL 500 MILLISECOND) AS start_rounded,
       date_trunc('second', sqlserver_start_time) AS start_truncated FROM raw_osinfo""")
def q_second_precision(spark, sf_dir):
    """round (DATETIME2(0)) and truncate (cycle stamp) to the second."""
    o = raw(spark, sf_dir).raw_osinfo
    return o.select("instance_id", "collected_at", X.second_round("sqlserver_start_time").alias("start_rounded"),
                    X.second_trunc("sqlserver_start_time").alias("start_truncated"))


@register("name_lookup", """
SELECT d.instance_id, d.database_id, l.login_name AS owner_name
FROM raw_sysdb d LEFT JOIN raw_logins l ON l.sid = d.owner_sid""")
def q_name_lookup(spark, sf_dir):
    """id-to-name lookup as a left join to a small name table."""
    r = raw(spark, sf_dir)
    return r.raw_sysdb.join(r.raw_logins.withColumnRenamed("sid", "owner_sid"), "owner_sid", "left").select(
        "instance_id", "database_id", F.col("login_name").alias("owner_name"))
