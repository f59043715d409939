"""Golden end-to-end scoring test with hand-computed answers, plus edge cases."""

import datetime as dt

from pyspark.sql import functions as F

from fleetpulse.plans import scoring as V
from golden_fixture import golden_lake

AS_OF = "2026-05-27 13:05:00"


def _by_hour(df):
    return {r["coll_hr"].hour: r for r in df.collect()}


def test_golden_health_scores(spark):
    lake = golden_lake(spark)
    rows = _by_hour(V.health_scores(lake, AS_OF))
    assert set(rows) == {10, 11, 12}
    expect = {
        10: (0, 0, 0, 0, 0, 0, None, None),
        11: (1, 1, 0, 0, 0, 2, 20, 10),
        12: (2, 2, 1, 1, 2, 8, 100, 25),
    }
    for h, (cpu, mem, rl, wl, blk, irc, rms, wms) in expect.items():
        r = rows[h]
        got = (r.cpu_index, r.memory_index, r.read_latency_index, r.write_latency_index,
               r.blocking_index, r.irc_index, r.read_latency_ms, r.write_latency_ms)
        assert got == (cpu, mem, rl, wl, blk, irc, rms, wms), (h, got)
    assert round(rows[10].blocker_ratio, 3) == 0.0
    assert round(rows[11].blocker_ratio, 3) == 0.03
    assert round(rows[12].blocker_ratio, 3) == 0.2
    assert rows[12].year == 2026 and rows[12].month == 5


def test_golden_problematic(spark):
    lake = golden_lake(spark)
    rows = V.problematic_instances(lake, AS_OF).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.instance_fqn == "testsrv"
    assert r.is_unresponsive is False and r.is_high_irc is True
    assert r.failed_pings is None
    assert r.latest_coll_hr == dt.datetime(2026, 5, 27, 12, 0)
    assert r.irc_index == 8


def test_current_partial_hour_excluded(spark):
    lake = golden_lake(spark)
    hours = _by_hour(V.health_scores(lake, "2026-05-27 12:59:59"))
    assert set(hours) == {10, 11}


def test_missing_threshold_row_gives_band_2(spark):
    from fleetpulse import schemas as S

    seed = [r for r in S.THRESHOLD_SEED if r[0] != "cpu"]
    lake = golden_lake(spark, score_thresholds=seed)
    rows = _by_hour(V.health_scores(lake, AS_OF))
    assert {h: r.cpu_index for h, r in rows.items()} == {10: 2, 11: 2, 12: 2}


def test_flipped_direction(spark):
    seed = [("cpu", "lower_worse", 75.0, 90.0)] + [
        r for r in __import__("fleetpulse.schemas", fromlist=["x"]).THRESHOLD_SEED if r[0] != "cpu"
    ]
    lake = golden_lake(spark, score_thresholds=seed)
    rows = _by_hour(V.health_scores(lake, AS_OF))
    # lower_worse: >= 75 -> 0, >= 90 -> 1, else 2; busy = 50, 85, 96
    assert {h: r.cpu_index for h, r in rows.items()} == {10: 2, 11: 0, 12: 0}


def test_restart_hour_and_null_restart_dropped(spark):
    import golden_fixture as fx

    io = []
    for h, (r, sr, w, sw) in fx.IO.items():
        ts = dt.datetime(2026, 5, 27, h, 30)
        restart = dt.datetime(2026, 5, 27, 11, 5) if h == 11 else fx.RESTART
        io.append((1000, 7, "sqlserver", ts, 2026, 5, 27, restart, r, None, sr, w, None, sw, None, None))
    lake = golden_lake(spark, metric_database_io=io)
    lat = {r.coll_hr.hour: r for r in V.io_latency_hourly(lake.metric_database_io).collect()}
    # 11:00 is the restart hour -> dropped; 12:00 lags over the gap to 10:00.
    assert set(lat) == {12}
    assert lat[12].read_latency_ms == (130000 - 10000) // (3000 - 1000)
    io_null = [row[:7] + (None,) + row[8:] for row in io]
    lake2 = golden_lake(spark, metric_database_io=io_null)
    assert V.io_latency_hourly(lake2.metric_database_io).count() == 0


def test_counter_reset_gives_zero_delta(spark):
    io = [
        (1000, 7, "sqlserver", dt.datetime(2026, 5, 27, 10, 30), 2026, 5, 27, dt.datetime(2026, 5, 27, 3),
         1000, None, 10000, 1000, None, 5000, None, None),
        (1000, 7, "sqlserver", dt.datetime(2026, 5, 27, 11, 30), 2026, 5, 27, dt.datetime(2026, 5, 27, 3),
         2000, None, 5000, 2000, None, 15000, None, None),
    ]
    lake = golden_lake(spark, metric_database_io=io)
    r = V.io_latency_hourly(lake.metric_database_io).collect()
    assert len(r) == 1 and r[0].read_latency_ms == 0 and r[0].write_latency_ms == 10


def test_no_eligible_database_no_score(spark):
    dbs = [(1000, 3, "sqlserver", "master") + (None,) * 12 + (dt.datetime(2026, 5, 27, 12, 30),)]
    lake = golden_lake(spark, databases=dbs)
    assert V.health_scores(lake, AS_OF).count() == 0


def test_unresponsive_exactly_three_failures(spark):
    base = dt.datetime(2026, 5, 27, 10, 0)
    pings = [(1000, "sqlserver", base - dt.timedelta(days=2), 2026, 5, 25, 10, True)]
    for i in range(3):
        ts = base + dt.timedelta(minutes=5 * i)
        pings.append((1000, "sqlserver", ts, 2026, 5, 27, 5000, False))
    lake = golden_lake(spark, pings=pings)
    u = V.unresponsive(lake, AS_OF).collect()
    assert len(u) == 1 and u[0].failed_pings == 3
    lake2 = golden_lake(spark, pings=pings[:-1])
    assert V.unresponsive(lake2, AS_OF).count() == 0


def test_no_success_in_envelope_not_reported(spark):
    base = dt.datetime(2026, 5, 27, 10, 0)
    pings = [(1000, "sqlserver", base - dt.timedelta(days=28), 2026, 4, 29, 10, True)]
    pings += [(1000, "sqlserver", base + dt.timedelta(minutes=i), 2026, 5, 27, 5000, False) for i in range(5)]
    lake = golden_lake(spark, pings=pings)
    assert V.unresponsive(lake, AS_OF).count() == 0


def test_empty_inputs(spark):
    lake = golden_lake(spark, metric_cpu=[], metric_memory=[], metric_sessions=[],
                       metric_database_io=[], metric_blocking=[])
    assert V.health_scores(lake, AS_OF).count() == 0
    assert V.problematic_instances(lake, AS_OF).count() == 0


def test_half_even_rounding_of_averages(spark):
    import golden_fixture as fx

    cpu = [
        (1000, "sqlserver", dt.datetime(2026, 5, 27, 10, m), 2026, 5, 27, e, 0, 0)
        for m, e in ((10, 2), (20, 3))
    ]  # avg 2.5 -> 2 (half to even)
    lake = golden_lake(spark, metric_cpu=cpu)
    r = V.health_scores(lake, AS_OF).filter(F.hour("coll_hr") == 10).collect()
    assert r[0].sql_cpu == 2
    assert fx.CPU  # fixture constants stay importable


def test_latest_health_from_scores_fallback_matches(spark):
    """Scores older than the recent window are found through the exact fallback."""
    lake = golden_lake(spark)
    scores = V.health_scores(lake, AS_OF)
    late = "2026-06-10 00:00:00"  # two weeks later: nothing in the 2-day window
    got = V.latest_health_from_scores(scores, lake.instances, late).collect()
    assert [(r.instance_id, r.coll_hr.hour, r.irc_index) for r in got] == [(1000, 12, 8)]
    p = V.problematic_from_scores(lake, scores, late).collect()
    assert len(p) == 1 and p[0].irc_index == 8 and p[0].is_high_irc
