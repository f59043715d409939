"""Benchmark telemetry as table operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.scalar import percent_ratio

SNAPSHOT_COUNTERS = ("xact_commit", "xact_rollback", "tup_inserted", "deadlocks", "wal_bytes")


def snapshot_delta(snapshots: DataFrame) -> DataFrame:
    """B1: after - before per run for the counters, plus cache-hit percent.

    One aggregate with conditional maxima replaces the before/after self join.
    """
    def d(c):
        return (F.max(F.when(F.col("phase") == "after", F.col(c)))
                - F.max(F.when(F.col("phase") == "before", F.col(c)))).alias(c)

    agg = snapshots.groupBy("run_id").agg(*[d(c) for c in SNAPSHOT_COUNTERS + ("blks_read", "blks_hit")])
    return agg.select("run_id", *SNAPSHOT_COUNTERS, "blks_read", "blks_hit",
                      percent_ratio("blks_hit", "blks_read").alias("cache_hit_pct"))


def activity_sample(activity: DataFrame) -> DataFrame:
    """Per sample, counts by state and lock waits, longest open transaction."""
    return activity.groupBy("run_id", "sample_at").agg(
        F.count_if(F.col("state") == "active").alias("active"),
        F.count_if(F.col("state") == "idle in transaction").alias("idle_in_txn"),
        F.count_if(F.col("wait_event_type") == "Lock").alias("lock_waiters"),
        F.coalesce(F.round(F.max("xact_age_sec"), 2), F.lit(0.0)).alias("longest_txn_sec"),
    )


def run_peaks(samples: DataFrame) -> DataFrame:
    """Peaks of the four sampler columns per run."""
    return samples.groupBy("run_id").agg(
        F.max("active").alias("peak_active"), F.max("idle_in_txn").alias("peak_idle_txn"),
        F.max("lock_waiters").alias("peak_lock_waits"), F.max("longest_txn_sec").alias("longest_txn_sec"),
    )


def run_rates(runs: DataFrame) -> DataFrame:
    """rows/s and commits/s guarded for zero elapsed time, MB conversion."""
    el = F.col("elapsed_sec")
    return runs.select(
        "run_id", "method", "flush", "threads", "inlining", "rows_written", "commits", "elapsed_sec",
        F.when(el > 0, F.round(F.col("rows_written") / el, 1)).otherwise(F.lit(0.0)).alias("rows_per_sec"),
        F.when(el > 0, F.round(F.col("commits") / el, 2)).otherwise(F.lit(0.0)).alias("commits_per_sec"),
        F.round(F.col("bytes_written") / F.lit(1048576.0), 2).alias("mb_written"),
    )


def storage_stats(objects: DataFrame) -> DataFrame:
    """S10 per run: object count and MB under each run's prefix."""
    return objects.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("objects"), F.round(F.sum("size_bytes") / F.lit(1048576.0), 3).alias("storage_mb"))


def scorecard(runs: DataFrame, snapshots: DataFrame, activity: DataFrame, objects: DataFrame) -> DataFrame:
    """One row per run configuration joining rates, deltas, peaks and storage."""
    return (
        run_rates(runs)
        .join(snapshot_delta(snapshots), "run_id", "left")
        .join(run_peaks(activity_sample(activity)), "run_id", "left")
        .join(storage_stats(objects), "run_id", "left")
    )
