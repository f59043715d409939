"""Registered read-API queries (Q1-Q5) and their building blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

import fleetpulse.catalog.packs  # noqa: F401  (registers the instance-details oracle CTE)
from fleetpulse.catalog import register
from fleetpulse.plans import api as Q
from fleetpulse.plans import scoring as V
from fleetpulse.sources.derived import AS_OF, DerivedLake

LABEL = "supplier#000000001"
RUN_QUERY_SQL = (
    "SELECT instance_id, count(*) AS pings, sum(CASE WHEN is_success THEN 0 ELSE 1 END) AS failures "
    "FROM pings GROUP BY instance_id"
)


def lake(spark, sf_dir) -> DerivedLake:
    return DerivedLake(spark, sf_dir)


@register("list_instances", """
SELECT instance_fqn, platform, status, environment, engine_version, registered_at
FROM instances WHERE platform = 'sqlserver'""")
def q_list_instances(spark, sf_dir):
    """Q1 with a platform filter, ordered by label."""
    return Q.list_instances(lake(spark, sf_dir).instances, "sqlserver")


@register("ordered_list", """
SELECT instance_fqn, platform, status, environment, engine_version, registered_at FROM instances""")
def q_ordered_list(spark, sf_dir):
    """All instances ordered by label."""
    return Q.list_instances(lake(spark, sf_dir).instances)


_TOPK = """SELECT * FROM o_problematic
ORDER BY is_unresponsive DESC, irc_index DESC, failed_pings DESC NULLS LAST, instance_id LIMIT 25"""


@register("problematic_topk", _TOPK)
def q_problematic_topk(spark, sf_dir):
    """Q2: the flagship list, worst 25."""
    return Q.problematic_topk(lake(spark, sf_dir), AS_OF, 25)


@register("worst_topk", _TOPK)
def q_worst_topk(spark, sf_dir):
    """O2: worst-first order then LIMIT in one plan (TakeOrderedAndProject)."""
    return V.worst_first(V.problematic_instances(lake(spark, sf_dir), AS_OF, ordered=False)).limit(25)


def _latest_sql(name: str, src: str, cols: list[str], prefix: str, where: str = "") -> str:
    order = ", ".join(["collected_at DESC"] + [f"{c} DESC" for c in cols])
    return f"""{name} AS (
  SELECT instance_id, collected_at AS {prefix}_collected_at, {", ".join(cols)} FROM {src} {where}
  QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY {order}) = 1)"""


_DETAIL_CTES = ",\n".join([
    _latest_sql("q3_det", "o_instance_details",
                ["server_name", "product_version", "logical_cpu_count", "physical_memory_mb"], "details"),
    _latest_sql("q3_cpu", "metric_cpu", ["engine_cpu_percent", "other_cpu_percent", "system_idle_percent"], "cpu"),
    _latest_sql("q3_mem", "metric_memory", ["page_residency_seconds"], "memory",
                "WHERE page_residency_seconds IS NOT NULL"),
    _latest_sql("q3_ses", "metric_sessions", ["active_sessions"], "sessions"),
])

DETAIL_SQL = f"""WITH {_DETAIL_CTES}
SELECT i.instance_id, i.instance_fqn,
       d.details_collected_at, d.server_name, d.product_version, d.logical_cpu_count, d.physical_memory_mb,
       c.cpu_collected_at, c.engine_cpu_percent, c.other_cpu_percent, c.system_idle_percent,
       m.memory_collected_at, m.page_residency_seconds, s.sessions_collected_at, s.active_sessions,
       n.database_count
FROM instances i
LEFT JOIN q3_det d USING (instance_id)
LEFT JOIN q3_cpu c USING (instance_id)
LEFT JOIN q3_mem m USING (instance_id)
LEFT JOIN q3_ses s USING (instance_id)
LEFT JOIN (SELECT instance_id, count(DISTINCT database_id) AS database_count FROM databases GROUP BY ALL) n
  USING (instance_id)"""


@register("instance_detail", DETAIL_SQL)
def q_instance_detail(spark, sf_dir):
    """Q3 for the whole fleet (one row per instance)."""
    return Q.instance_detail(lake(spark, sf_dir), as_of=AS_OF)


@register("latest_one", """
SELECT instance_id, collected_at AS cpu_collected_at, engine_cpu_percent, other_cpu_percent, system_idle_percent
FROM metric_cpu
QUALIFY row_number() OVER (PARTITION BY instance_id
        ORDER BY collected_at DESC, engine_cpu_percent DESC, other_cpu_percent DESC, system_idle_percent DESC) = 1""")
def q_latest_one(spark, sf_dir):
    """O3 batch form: newest CPU row per instance via max_by."""
    return Q._latest(lake(spark, sf_dir).metric_cpu,
                     ["engine_cpu_percent", "other_cpu_percent", "system_idle_percent"], "cpu")


@register("distinct_count", """
SELECT instance_id, count(DISTINCT database_id) AS database_count FROM databases GROUP BY ALL""")
def q_distinct_count(spark, sf_dir):
    """Exact distinct database count per instance (system and dropped ones included, D10)."""
    return lake(spark, sf_dir).databases.groupBy("instance_id").agg(
        F.countDistinct("database_id").alias("database_count")
    )


@register("metric_history", f"""
SELECT m.collected_at, m.engine_cpu_percent, m.other_cpu_percent, m.system_idle_percent
FROM metric_cpu m JOIN instances i USING (instance_id)
WHERE i.instance_fqn = '{LABEL}' AND m.collected_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 720 HOUR""")
def q_metric_history(spark, sf_dir):
    """Q4: CPU history of one instance over 720 hours, ascending."""
    return Q.metric_history(lake(spark, sf_dir), LABEL, "cpu", 720, AS_OF)


@register("ordered_series", f"""
SELECT m.collected_at, m.page_residency_seconds
FROM metric_memory m JOIN instances i USING (instance_id)
WHERE i.instance_fqn = '{LABEL}' AND m.collected_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 240 HOUR""")
def q_ordered_series(spark, sf_dir):
    """Memory history (NULL PLE rows kept), ascending by time."""
    return Q.metric_history(lake(spark, sf_dir), LABEL, "memory", 240, AS_OF)


@register("label_lookup_join", """
SELECT m.collected_at, m.active_sessions
FROM metric_sessions m JOIN instances i USING (instance_id)
WHERE i.instance_fqn = 'supplier#000000002'""")
def q_label_lookup_join(spark, sf_dir):
    """``JOIN .. USING (instance_id)`` filtered by a unique label."""
    lk = lake(spark, sf_dir)
    inst = lk.instances.filter(F.col("instance_fqn") == "supplier#000000002").select("instance_id")
    return lk.metric_sessions.join(inst, "instance_id").select("collected_at", "active_sessions")


@register("run_query", RUN_QUERY_SQL)
def q_run_query(spark, sf_dir):
    """Bounded read-only SQL over the registered lake views (limit 5000)."""
    with Q.views(spark, lake(spark, sf_dir), ["pings"]):
        return Q.run_query(spark, RUN_QUERY_SQL + ";", 5000)


LAKE_QUERY_SQL = (
    "SELECT i.instance_fqn, count(*) AS pings, max(p.response_time_ms) AS slowest FROM common.pings p "
    "JOIN common.instances i ON i.instance_id = p.instance_id WHERE p.day >= 10 GROUP BY i.instance_fqn"
)


@register("run_query_lake", LAKE_QUERY_SQL.replace("common.", ""))
def q_run_query_lake(spark, sf_dir):
    """Q5 / P12 over the stored lake, tables named by their namespaces as readers know them."""
    from fleetpulse.plans.ingest import scratch_path
    from fleetpulse.sources.lake import catalog_tables, materialize

    names = ("pings", "instances")
    with catalog_tables(materialize(lake(spark, sf_dir), scratch_path(spark, "lake_sql"), names), names):
        return Q.run_query(spark, LAKE_QUERY_SQL, 5000)


@register("json_rows", """
SELECT '{"instance_id":' || instance_id || ',"collected_at":"' || strftime(collected_at, '%Y-%m-%dT%H:%M:%S.%g') || '","big_bytes":'
       || CASE WHEN num_of_bytes_read + 9007199254740992 > 9007199254740991 THEN '"' || (num_of_bytes_read + 9007199254740992) || '"'
               ELSE coalesce(CAST(num_of_bytes_read + 9007199254740992 AS VARCHAR), 'null') END
       || ',"num_of_reads":' || coalesce(CAST(num_of_reads AS VARCHAR), 'null') || '}' AS json FROM metric_database_io""")
def q_json_rows(spark, sf_dir):
    """Rows rendered as JSON text."""
    lk = lake(spark, sf_dir)
    df = lk.metric_database_io.select(
        "instance_id", "collected_at", (F.col("num_of_bytes_read") + F.lit(1 << 53)).alias("big_bytes"),
        "num_of_reads",
    )
    return Q.json_rows(df)
