"""Physical-plan shape checks for the registered queries (no execution)."""

import re

import pytest

SF = "/root/testdata/sf0.001"

# Keys whose callables write and read back (they run jobs when called).
WRITES = {
    "collector_ingest", "partitioned_append", "lake_scan", "collection_log", "fleet_csv", "raw_stage",
    "file_stats", "sync_dimension", "compact_partitions", "retention", "materialize_scores", "hourly_stream",
    "dedup_stream", "counter_delta_stream", "scorecard_csv", "materialize_scores_incremental", "high_irc_from_state",
    "problematic_from_state", "instance_detail_from_state", "collector_ingest_stream", "rejected_error_rows",
    "cadence_tier_streams", "get_or_create_ids", "quarantined_records", "run_query_lake", "file_counts",
}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_or_nested_loop_joins(spark):
    import __spark_entry__ as entry

    bad = {}
    for key, fn in entry.queries().items():
        if key in WRITES:
            continue
        plan = _plan(fn(spark, SF))
        hits = [p for p in ("CartesianProduct", "BroadcastNestedLoopJoin") if p in plan]
        if hits:
            bad[key] = hits
    assert not bad, bad


def test_flagship_scans_are_pruned_and_filtered(spark):
    import __spark_entry__ as entry

    df = entry.queries()["problematic_instances"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [ln for ln in plan.splitlines() if "FileScan parquet" in ln]
    assert scans
    for ln in scans:
        schema = re.search(r"ReadSchema: struct<([^>]*)>", ln)
        assert schema, ln
        # no scan reads every column of the events or supplier tables
        assert len(schema.group(1).split(",")) <= 5, ln
    events = [ln for ln in scans if "events.parquet" in ln]
    assert any("GreaterThan(ts," in ln for ln in events), "ping windows must reach the scan"
    assert any("LessThan(ts," in ln for ln in events), "closed-hour cut must reach the scan"


def test_latest_per_key_combines_map_side(spark):
    from fleetpulse.operators.windows import latest_per_key
    from fleetpulse.sources.derived import DerivedLake

    p = DerivedLake(spark, SF).pings
    plan = _plan(latest_per_key(p, ["instance_id"], ["collected_at"], ["response_time_ms"]))
    assert "partial_max_by" in plan and "Window" not in plan


@pytest.mark.parametrize("key", ["health_scores", "top_waits", "wait_deltas", "ping_early_warning"])
def test_windows_are_partitioned(spark, key):
    import __spark_entry__ as entry

    plan = _plan(entry.queries()[key](spark, SF))
    for ln in plan.splitlines():
        if re.search(r"\bWindow \[", ln) and "_pid" not in ln:
            # every window has a non-empty partition spec: "Window [exprs], [partition], [order]"
            parts = re.findall(r"\], \[([^\]]*)\]", ln)
            assert parts and parts[0].strip(), ln


def test_stored_lake_prunes_folders(spark, scratch):
    import os

    from fleetpulse.plans import scoring as V
    from fleetpulse.sources.derived import DerivedLake
    from fleetpulse.sources.lake import materialize

    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # keep scan paths in the plan text
    stored = materialize(DerivedLake(spark, SF), os.path.join(scratch, "lake"))
    plan = _plan(V.problematic_instances(stored, "2024-01-31 00:00:00"))
    fact_scans = [ln for ln in plan.splitlines() if "FileScan parquet" in ln and "/common/metric_" in ln]
    assert fact_scans
    for ln in fact_scans:
        assert "PartitionFilters: [" in ln and "make_date" in ln, ln
        assert "LessThan(collected_at" in ln, ln
    ping_scans = [ln for ln in plan.splitlines() if "FileScan parquet" in ln and "/common/pings" in ln]
    assert ping_scans and all("make_date" in ln and "GreaterThan(collected_at" in ln for ln in ping_scans)
    assert V.problematic_instances(stored, "2024-01-31 00:00:00").count() >= 1


def test_top_n_limits_groups_before_the_shuffle(spark):
    import __spark_entry__ as entry

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # inspect the static plan
    try:
        plan = _plan(entry.queries()["top_waits"](spark, SF))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "WindowGroupLimit" in plan and "Partial" in plan
