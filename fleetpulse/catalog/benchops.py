"""Registered benchmark-telemetry operators (B1-B5; A9/B2 and A10/B3 registered once)."""

from __future__ import annotations

import fleetpulse.catalog.packs  # noqa: F401  (raw oracle CTEs)
from fleetpulse.catalog import register
from fleetpulse.checks.oracle import register as register_cte
from fleetpulse.plans import benchops as B
from fleetpulse.plans import ingest as I
from fleetpulse.sources.raw import RawSnapshots


def raw(spark, sf_dir) -> RawSnapshots:
    return RawSnapshots(spark, sf_dir)


_COUNTERS = list(B.SNAPSHOT_COUNTERS) + ["blks_read", "blks_hit"]

register_cte("o_snapshot_delta", "SELECT run_id, " + ", ".join(
    f"max(CASE WHEN phase = 'after' THEN {c} END) - max(CASE WHEN phase = 'before' THEN {c} END) AS {c}"
    for c in _COUNTERS) + " FROM raw_pg_snapshots GROUP BY run_id")
register_cte("o_samples", """
SELECT run_id, sample_at, count(*) FILTER (WHERE state = 'active') AS active,
       count(*) FILTER (WHERE state = 'idle in transaction') AS idle_in_txn,
       count(*) FILTER (WHERE wait_event_type = 'Lock') AS lock_waiters,
       coalesce(round(max(xact_age_sec), 2), 0.0) AS longest_txn_sec
FROM raw_activity GROUP BY run_id, sample_at""")
register_cte("o_peaks", """
SELECT run_id, max(active) AS peak_active, max(idle_in_txn) AS peak_idle_txn,
       max(lock_waiters) AS peak_lock_waits, max(longest_txn_sec) AS longest_txn_sec
FROM o_samples GROUP BY run_id""")
register_cte("o_rates", """
SELECT run_id, method, flush, threads, inlining, rows_written, commits, elapsed_sec,
       CASE WHEN elapsed_sec > 0 THEN round(rows_written / elapsed_sec, 1) ELSE 0.0 END AS rows_per_sec,
       CASE WHEN elapsed_sec > 0 THEN round(commits / elapsed_sec, 2) ELSE 0.0 END AS commits_per_sec,
       round(bytes_written / 1048576.0, 2) AS mb_written
FROM raw_runs""")
register_cte("o_storage", """
SELECT run_id, count(*) AS objects, round(sum(size_bytes) / 1048576.0, 3) AS storage_mb
FROM raw_objects GROUP BY run_id""")
register_cte("o_scorecard", """
SELECT r.*, d.xact_commit, d.xact_rollback, d.tup_inserted, d.deadlocks, d.wal_bytes, d.blks_read, d.blks_hit,
       CASE WHEN d.blks_hit + d.blks_read > 0 THEN round(d.blks_hit / (d.blks_read + d.blks_hit) * 100.0, 1)
            ELSE 100.0 END AS cache_hit_pct,
       p.peak_active, p.peak_idle_txn, p.peak_lock_waits, p.longest_txn_sec, s.objects, s.storage_mb
FROM o_rates r LEFT JOIN o_snapshot_delta d USING (run_id) LEFT JOIN o_peaks p USING (run_id)
LEFT JOIN o_storage s USING (run_id)""")


@register("snapshot_delta", """
SELECT *, CASE WHEN blks_hit + blks_read > 0 THEN round(blks_hit / (blks_read + blks_hit) * 100.0, 1)
               ELSE 100.0 END AS cache_hit_pct FROM o_snapshot_delta""")
def q_snapshot_delta(spark, sf_dir):
    """B1 (+ F19 percent ratio)."""
    return B.snapshot_delta(raw(spark, sf_dir).raw_pg_snapshots)


@register("percent_ratio", """
SELECT run_id, CASE WHEN blks_hit + blks_read > 0 THEN round(blks_hit / (blks_read + blks_hit) * 100.0, 1)
                    ELSE 100.0 END AS cache_hit_pct FROM o_snapshot_delta""")
def q_percent_ratio(spark, sf_dir):
    """F19."""
    return B.snapshot_delta(raw(spark, sf_dir).raw_pg_snapshots).select("run_id", "cache_hit_pct")


@register("filtered_counts", "SELECT * FROM o_samples")
def q_filtered_counts(spark, sf_dir):
    """``count(*) FILTER`` x3 and a rounded, coalesced max per sample."""
    return B.activity_sample(raw(spark, sf_dir).raw_activity)


@register("run_peaks", "SELECT * FROM o_peaks")
def q_run_peaks(spark, sf_dir):
    """A10 / B3."""
    return B.run_peaks(B.activity_sample(raw(spark, sf_dir).raw_activity))


@register("run_rates", "SELECT * FROM o_rates")
def q_run_rates(spark, sf_dir):
    """B4."""
    return B.run_rates(raw(spark, sf_dir).raw_runs)


@register("scorecard", "SELECT * FROM o_scorecard")
def q_scorecard(spark, sf_dir):
    """B5."""
    r = raw(spark, sf_dir)
    return B.scorecard(r.raw_runs, r.raw_pg_snapshots, r.raw_activity, r.raw_objects)


@register("scorecard_csv", """
SELECT run_id, method, rows_per_sec, commits_per_sec, cache_hit_pct, peak_active, objects FROM o_scorecard""")
def q_scorecard_csv(spark, sf_dir):
    """Export the scorecard to CSV and read it back with a schema."""
    r = raw(spark, sf_dir)
    sc = B.scorecard(r.raw_runs, r.raw_pg_snapshots, r.raw_activity, r.raw_objects).select(
        "run_id", "method", "rows_per_sec", "commits_per_sec", "cache_hit_pct", "peak_active", "objects")
    path = I.scratch_path(spark, "scorecard")
    I.write_csv(sc, path)
    return I.read_csv(spark, path, "run_id int, method string, rows_per_sec double, commits_per_sec double, "
                                   "cache_hit_pct double, peak_active bigint, objects bigint")
