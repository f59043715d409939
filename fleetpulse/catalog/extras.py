"""Registered read-side extras (G1-G5) over collected tables."""

from __future__ import annotations

import fleetpulse.catalog.packs  # noqa: F401  (registers the K-query SQL reused below)
from fleetpulse.catalog import SQL, register
from fleetpulse.checks.oracle import register as register_cte
from fleetpulse.plans import extras as G
from fleetpulse.plans import packs as K
from fleetpulse.sources.derived import AS_OF, DerivedLake
from fleetpulse.sources.raw import RawSnapshots

register_cte("o_top_waits", SQL["top_waits"])
register_cte("o_perf_wide", SQL["perf_counters_wide"])
register_cte("o_backup_status", SQL["backup_status"])
register_cte("o_config_settings", SQL["config_settings"])


def raw(spark, sf_dir) -> RawSnapshots:
    return RawSnapshots(spark, sf_dir)


def _guard(cur: str, prev: str) -> str:
    return (f"CAST(CASE WHEN prev_restart IS NOT DISTINCT FROM last_restart_at AND {prev} <= {cur} "
            f"THEN {cur} - {prev} ELSE 0 END AS BIGINT)")


@register("wait_deltas", f"""
WITH g1 AS (
  SELECT instance_id, wait_type, collected_at, last_restart_at, wait_time_ms, waiting_tasks_count,
         lag(wait_time_ms) OVER w AS prev_wait, lag(waiting_tasks_count) OVER w AS prev_tasks,
         lag(last_restart_at) OVER w AS prev_restart
  FROM o_top_waits WINDOW w AS (PARTITION BY instance_id, wait_type ORDER BY collected_at)),
g1d AS (
  SELECT instance_id, wait_type, collected_at, {_guard('wait_time_ms', 'prev_wait')} AS delta_wait_ms,
         {_guard('waiting_tasks_count', 'prev_tasks')} AS delta_tasks
  FROM g1 WHERE prev_wait IS NOT NULL)
SELECT *, delta_wait_ms / NULLIF(delta_tasks, 0) AS avg_wait_ms,
       delta_wait_ms / NULLIF(sum(delta_wait_ms) OVER (PARTITION BY instance_id, collected_at), 0) * 100.0
         AS pct_of_waits
FROM g1d""")
def q_wait_deltas(spark, sf_dir):
    """G1: wait deltas guarded by counter reset and restart change, with per-snapshot shares."""
    return G.wait_deltas(K.top_waits(raw(spark, sf_dir)))


_RATES = ", ".join(
    f"{_guard(c, 'prev_' + c)} / NULLIF((epoch_us(collected_at) - epoch_us(prev_at)) / 1e6, 0) AS {out}"
    for c, out in G.PERF_RATES)
_LAGS = ", ".join(f"lag({c}) OVER w AS prev_{c}" for c, _ in G.PERF_RATES)


@register("perf_rates", f"""
WITH g2 AS (
  SELECT *, lag(collected_at) OVER w AS prev_at, lag(last_restart_at) OVER w AS prev_restart, {_LAGS}
  FROM o_perf_wide WINDOW w AS (PARTITION BY instance_id ORDER BY collected_at))
SELECT instance_id, collected_at, (epoch_us(collected_at) - epoch_us(prev_at)) / 1e6 AS seconds, {_RATES}
FROM g2 WHERE prev_at IS NOT NULL""")
def q_perf_rates(spark, sf_dir):
    """Per-second rates between consecutive counter snapshots."""
    return G.perf_rates(K.perf_counters_wide(raw(spark, sf_dir)))


@register("backup_staleness", f"""
SELECT instance_id, database_id, database_name,
       (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(last_full_backup)) / 1e6 / CAST(3600 AS DOUBLE) AS hours_since_full,
       coalesce((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(last_full_backup)) / 1e6 / CAST(3600 AS DOUBLE) > {G.STALE_BACKUP_HOURS},
                TRUE) AS is_stale
FROM o_backup_status
QUALIFY row_number() OVER (PARTITION BY instance_id, database_id ORDER BY collected_at DESC) = 1""")
def q_backup_staleness(spark, sf_dir):
    """Backup age in hours on the newest snapshot; never backed up counts as stale."""
    return G.backup_staleness(K.backup_status(raw(spark, sf_dir)), AS_OF)


@register("config_drift", """
SELECT instance_id, setting_name, collected_at, running_value, previous_value FROM (
  SELECT instance_id, setting_name, collected_at, running_value,
         lag(running_value) OVER w AS previous_value, lag(collected_at) OVER w AS prev_at
  FROM o_config_settings WINDOW w AS (PARTITION BY instance_id, setting_name ORDER BY collected_at)) x
WHERE prev_at IS NOT NULL AND running_value IS DISTINCT FROM previous_value""")
def q_config_drift(spark, sf_dir):
    """Running-value changes between consecutive snapshots."""
    return G.config_drift(K.config_settings(raw(spark, sf_dir)))


@register("ping_early_warning", """
WITH g5 AS (
  SELECT instance_id, collected_at, response_time_ms, is_success,
         sum(CAST(is_success AS INTEGER)) OVER (PARTITION BY instance_id
             ORDER BY collected_at, response_time_ms, is_success ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           AS island,
         avg(response_time_ms) OVER (PARTITION BY instance_id
             ORDER BY collected_at, response_time_ms, is_success ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)
           AS avg_response_12
  FROM pings)
SELECT instance_id, collected_at, is_success, failure_run, avg_response_12, failure_run >= 3 AS is_offline FROM (
  SELECT *, sum(CASE WHEN is_success THEN 0 ELSE 1 END) OVER (PARTITION BY instance_id, island
             ORDER BY collected_at, response_time_ms, is_success ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           AS failure_run
  FROM g5) y""")
def q_ping_early_warning(spark, sf_dir):
    """Failure-run length (gaps and islands) and trailing 12-ping average response."""
    return G.ping_early_warning(DerivedLake(spark, sf_dir).pings)
