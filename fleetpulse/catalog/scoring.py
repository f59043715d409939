"""Registered scoring-chain queries (V1-V14) over the derived lake."""

from __future__ import annotations

from pyspark.sql import functions as F

import fleetpulse.checks.oracle_scoring  # noqa: F401  (registers oracle CTEs)
from fleetpulse import schemas as S
from fleetpulse.catalog import register
from fleetpulse.plans import scoring as V
from fleetpulse.sources.derived import AS_OF, DerivedLake


def lake(spark, sf_dir) -> DerivedLake:
    return DerivedLake(spark, sf_dir)


@register("databases_latest", "SELECT * FROM o_databases_latest")
def q_databases_latest(spark, sf_dir):
    return V.databases_latest(lake(spark, sf_dir).databases)


@register("eligible_databases", "SELECT * FROM o_eligible")
def q_eligible_databases(spark, sf_dir):
    lk = lake(spark, sf_dir)
    return V.eligible_databases(lk.databases, lk.instances)


@register("cpu_hourly", "SELECT * FROM o_cpu_hourly")
def q_cpu_hourly(spark, sf_dir):
    return V.cpu_hourly(lake(spark, sf_dir).metric_cpu)


@register("memory_hourly", "SELECT * FROM o_memory_hourly")
def q_memory_hourly(spark, sf_dir):
    return V.memory_hourly(lake(spark, sf_dir).metric_memory)


@register("sessions_hourly", "SELECT * FROM o_sessions_hourly")
def q_sessions_hourly(spark, sf_dir):
    return V.sessions_hourly(lake(spark, sf_dir).metric_sessions)


@register("io_bucketed", "SELECT * FROM o_io_bucketed")
def q_io_bucketed(spark, sf_dir):
    return V.io_bucketed(lake(spark, sf_dir).metric_database_io)


@register("io_lagged", "SELECT * FROM o_io_lagged")
def q_io_lagged(spark, sf_dir):
    return V.io_lagged(lake(spark, sf_dir).metric_database_io)


@register("io_deltas", "SELECT * FROM o_io_deltas")
def q_io_deltas(spark, sf_dir):
    return V.io_deltas(lake(spark, sf_dir).metric_database_io)


@register("io_latency_hourly", "SELECT * FROM o_io_latency")
def q_io_latency_hourly(spark, sf_dir):
    return V.io_latency_hourly(lake(spark, sf_dir).metric_database_io)


@register("blocking_hourly", "SELECT * FROM o_blocking_hourly")
def q_blocking_hourly(spark, sf_dir):
    return V.blocking_hourly(lake(spark, sf_dir).metric_blocking)


@register("cpu_busy", "SELECT DISTINCT instance_id, coll_hr, cpu_busy_pct FROM o_health_base")
def q_cpu_busy(spark, sf_dir):
    """V8: engine + other CPU per scored instance-hour (NULL if either part is NULL)."""
    return V.health_base(lake(spark, sf_dir), AS_OF).select("instance_id", "coll_hr", "cpu_busy_pct").distinct()


@register("blocker_ratio", "SELECT instance_id, database_id, coll_hr, blocker_ratio FROM o_health_base")
def q_blocker_ratio(spark, sf_dir):
    """V9: peak blockers over average sessions per database-hour."""
    return V.health_base(lake(spark, sf_dir), AS_OF).select(
        "instance_id", "database_id", "coll_hr", "blocker_ratio"
    )


@register("health_scores", "SELECT * FROM o_health_scores")
def q_health_scores(spark, sf_dir):
    return V.health_scores(lake(spark, sf_dir), AS_OF)


@register("health_scores_instance", "SELECT * FROM o_health_instance")
def q_health_scores_instance(spark, sf_dir):
    return V.health_scores_instance(lake(spark, sf_dir), AS_OF)


@register("unresponsive", "SELECT * FROM o_unresponsive")
def q_unresponsive(spark, sf_dir):
    return V.unresponsive(lake(spark, sf_dir), AS_OF)


@register("high_irc", "SELECT * FROM o_high_irc")
def q_high_irc(spark, sf_dir):
    return V.high_irc(lake(spark, sf_dir), AS_OF)


@register("problematic_instances", "SELECT * FROM o_problematic")
def q_problematic_instances(spark, sf_dir):
    return V.problematic_instances(lake(spark, sf_dir), AS_OF)


@register("worst_first", "SELECT * FROM o_problematic")
def q_worst_first(spark, sf_dir):
    """O1: the flagship list in worst-first order."""
    return V.worst_first(V.problematic_instances(lake(spark, sf_dir), AS_OF, ordered=False))


@register("union_distinct_keys", "SELECT * FROM o_problem_keys")
def q_union_distinct_keys(spark, sf_dir):
    """UNION (distinct) of the two problem key sets."""
    lk = lake(spark, sf_dir)
    u = V.unresponsive(lk, AS_OF).select("instance_id")
    h = V.high_irc(lk, AS_OF).select("instance_id")
    return u.union(h).distinct()


_RULES = "(VALUES " + ", ".join(f"('{n}', '{d}', {w}::DOUBLE, {c}::DOUBLE)" for n, d, w, c in S.THRESHOLD_SEED) + ") r(index_name, direction, warn, crit)"
_PIVOT = ", ".join(f"max({col}) FILTER (index_name = '{n}') AS {n}_{out}" for n in V.INDEXES for col, out in (("direction", "dir"), ("warn", "warn"), ("crit", "crit")))


@register("threshold_pivot", f"""
SELECT instance_id, {_PIVOT} FROM (
  SELECT instance_id, index_name, direction, warn * (1 + instance_id % 5) AS warn, crit * (1 + instance_id % 5) AS crit
  FROM instances, {_RULES}) x GROUP BY instance_id""")
def q_threshold_pivot(spark, sf_dir):
    """A4: every instance's own rules (the seed, scaled by instance) pivoted to one row."""
    rules = F.explode(F.array(*(F.struct(F.lit(n).alias("index_name"), F.lit(d).alias("direction"), F.lit(w).alias("w"), F.lit(c).alias("c"))
                                for n, d, w, c in S.THRESHOLD_SEED)))
    own = lake(spark, sf_dir).instances.select("instance_id", (1 + F.col("instance_id") % 5).alias("scale"), rules.alias("r"))
    scaled = own.select("instance_id", "r.index_name", "r.direction", (F.col("r.w") * F.col("scale")).alias("warn_threshold"),
                        (F.col("r.c") * F.col("scale")).alias("crit_threshold"))
    return V.threshold_pivot(scaled, ("instance_id",))


@register("last_success", "SELECT * FROM o_last_success")
def q_last_success(spark, sf_dir):
    return V.last_success(lake(spark, sf_dir).pings, AS_OF)


@register("count_having", "SELECT instance_id, CAST(failed_pings AS BIGINT) AS failed_pings FROM o_recent_failures")
def q_count_having(spark, sf_dir):
    """Failures after the last success, kept when at least 3."""
    return V.recent_failures(lake(spark, sf_dir).pings, AS_OF).select(
        "instance_id", F.col("failed_pings").cast("long").alias("failed_pings")
    )
