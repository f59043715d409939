"""Read-side analytics the reference promises but does not implement.

The semantics are this package's choice, reusing the lag/guard operators.
Series windows (previous snapshot, failure runs, trailing averages) use the
bounded-group operators: a key's history is cut into fixed-size blocks with a
small halo, so one hot instance never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.functions.scalar import epoch_seconds_between, nullif_zero
from fleetpulse.operators.windows import DEFAULT_BLOCK, key_ordinal, lag_bounded, run_length_since, \
    trailing_avg_bounded
from fleetpulse.plans.scoring import as_of_col

STALE_BACKUP_HOURS = 168
OFFLINE_RUN = 3
TRAILING_PINGS = 12


def _guarded(cur: str, prev: str, same_restart) -> F.Column:
    c, p = F.col(cur), F.col(prev)
    return F.when(same_restart & (p <= c), c - p).otherwise(F.lit(0)).cast("long")


def wait_deltas(waits: DataFrame) -> DataFrame:
    """G1: per (instance, wait type) deltas between snapshots, reset-guarded by the counter
    and by a changed restart time; average wait per task and share of the snapshot's waits.

    A wait type has one row per snapshot of its instance, so a plain window per series holds as many rows as there were
    snapshots, whatever an instance's share of the table.
    """
    series = Window.partitionBy("instance_id", "wait_type").orderBy("collected_at")
    lagged = waits.select(
        "instance_id", "wait_type", "collected_at", "last_restart_at", "wait_time_ms", "waiting_tasks_count",
        F.lag("wait_time_ms").over(series).alias("prev_wait"), F.lag("waiting_tasks_count").over(series).alias("prev_tasks"),
        F.lag("last_restart_at").over(series).alias("prev_restart"),
    ).filter(F.col("prev_wait").isNotNull())
    same = F.col("prev_restart").eqNullSafe(F.col("last_restart_at"))
    d = lagged.select(
        "instance_id", "wait_type", "collected_at",
        _guarded("wait_time_ms", "prev_wait", same).alias("delta_wait_ms"),
        _guarded("waiting_tasks_count", "prev_tasks", same).alias("delta_tasks"),
    )
    snap = Window.partitionBy("instance_id", "collected_at")
    return d.select(
        "*",
        (F.col("delta_wait_ms") / nullif_zero("delta_tasks")).alias("avg_wait_ms"),
        (F.col("delta_wait_ms") / nullif_zero(F.sum("delta_wait_ms").over(snap)) * 100.0).alias("pct_of_waits"),
    )


PERF_RATES = (
    ("batch_requests_per_sec_cumulative", "batch_requests_per_sec"),
    ("sql_compilations_cumulative", "compilations_per_sec"),
    ("transactions_cumulative", "transactions_per_sec"),
)


def perf_rates(perf: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Per-second rates from cumulative counters between consecutive snapshots."""
    base = perf.select("instance_id", "collected_at", "last_restart_at", *[c for c, _ in PERF_RATES],
                       F.col("collected_at").alias("at"), F.col("last_restart_at").alias("restart"))
    lagged = lag_bounded(base, ["instance_id"], ["collected_at"],
                         ["at", "restart"] + [c for c, _ in PERF_RATES], block=block)
    lagged = lagged.withColumnsRenamed({"prev_at": "prev_at", "prev_restart": "prev_restart"}) \
        .filter(F.col("prev_at").isNotNull())
    secs = epoch_seconds_between("collected_at", "prev_at")
    same = F.col("prev_restart").eqNullSafe(F.col("last_restart_at"))
    return lagged.select(
        "instance_id", "collected_at", secs.alias("seconds"),
        *[(_guarded(c, f"prev_{c}", same) / F.nullif(secs, F.lit(0.0))).alias(out) for c, out in PERF_RATES],
    )


def backup_staleness(backups: DataFrame, as_of) -> DataFrame:
    """Hours since the last full backup on the newest snapshot per database."""
    from fleetpulse.operators.windows import latest_per_key

    latest = latest_per_key(
        backups.select("instance_id", "database_id", "collected_at", "database_name", "last_full_backup"),
        ["instance_id", "database_id"], ["collected_at"])
    hours = epoch_seconds_between(as_of_col(as_of), "last_full_backup") / 3600.0
    return latest.select(
        "instance_id", "database_id", "database_name", hours.alias("hours_since_full"),
        F.coalesce(hours > STALE_BACKUP_HOURS, F.lit(True)).alias("is_stale"),
    )


def config_drift(settings: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Setting changes between consecutive snapshots (previous and new running value)."""
    base = settings.select("instance_id", "setting_name", "collected_at", "running_value",
                           F.col("collected_at").alias("_at"))
    lagged = lag_bounded(base, ["instance_id", "setting_name"], ["collected_at"], ["running_value", "_at"],
                         block=block).withColumnsRenamed({"prev_running_value": "previous_value",
                                                          "prev__at": "_prev_at"}).drop("_at", "_ord")
    return lagged.filter(F.col("_prev_at").isNotNull() & ~F.col("running_value").eqNullSafe(F.col("previous_value"))) \
        .drop("_prev_at")


def ping_early_warning(pings: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Consecutive-failure run length (gaps and islands) and a trailing average
    response time over the last 12 pings; a run of 3+ failures marks offline."""
    order = ["collected_at", "response_time_ms", "is_success"]
    o = key_ordinal(pings.select("instance_id", *order), ["instance_id"], order)
    o = trailing_avg_bounded(o, ["instance_id"], TRAILING_PINGS, "response_time_ms", "avg_response_12", block)
    o = run_length_since(o, ["instance_id"], "is_success", "failure_run", block)
    return o.select("instance_id", "collected_at", "is_success", "failure_run", "avg_response_12",
                    (F.col("failure_run") >= OFFLINE_RUN).alias("is_offline"))
