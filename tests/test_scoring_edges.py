"""Remaining scoring edge cases on the golden fixture."""

import datetime as dt

from fleetpulse.plans import scoring as V
from golden_fixture import golden_lake

AS_OF = "2026-05-27 13:05:00"
R = dt.datetime(2026, 5, 27, 3, 0)


def _io(rows):
    out = []
    for h, (r, sr, w, sw) in rows:
        ts = dt.datetime(2026, 5, 27, h, 30)
        out.append((1000, 7, "sqlserver", ts, 2026, 5, 27, R, r, None, sr, w, None, sw, None, None))
    return out


def test_zero_counter_in_prior_bucket_drops_row(spark):
    lake = golden_lake(spark, metric_database_io=_io([(10, (0, 0, 1000, 500)), (11, (1000, 5000, 2000, 900))]))
    assert V.io_latency_hourly(lake.metric_database_io).count() == 0


def test_only_reads_moving_drops_row(spark):
    lake = golden_lake(spark, metric_database_io=_io([(10, (1000, 10000, 1000, 5000)),
                                                      (11, (2000, 30000, 1000, 5000))]))
    assert V.io_latency_hourly(lake.metric_database_io).count() == 0


def _cpu(e, o):
    return [(1000, "sqlserver", dt.datetime(2026, 5, 27, 10, 30), 2026, 5, 27, e, o, 0)]


def test_value_exactly_on_threshold_and_null_cpu_part(spark):
    at_warn = V.health_scores(golden_lake(spark, metric_cpu=_cpu(70, 5)), AS_OF).first()
    assert at_warn.cpu_index == 1  # 75 is not < 75 -> band 1
    at_crit = V.health_scores(golden_lake(spark, metric_cpu=_cpu(80, 10)), AS_OF).first()
    assert at_crit.cpu_index == 2
    null_part = V.health_scores(golden_lake(spark, metric_cpu=_cpu(None, 10)), AS_OF).first()
    assert null_part.cpu_index == 0 and null_part.sql_cpu is None


def test_zero_and_missing_sessions_give_null_ratio(spark):
    t = dt.datetime(2026, 5, 27, 11, 30)
    zero = golden_lake(spark, metric_sessions=[(1000, "sqlserver", t, 2026, 5, 27, 0)])
    rows = {r.coll_hr.hour: r for r in V.health_scores(zero, AS_OF).collect()}
    assert rows[11].blocker_ratio is None and rows[11].blocking_index == 0
    assert rows[12].blocker_ratio is None and rows[12].avg_active_sessions is None


def test_system_database_and_non_production_excluded(spark):
    snap = dt.datetime(2026, 5, 27, 12, 30)
    dbs = [(1000, 7, "sqlserver", "msdb") + (None,) * 12 + (snap,),
           (1000, 3, "sqlserver", "AppDb") + (None,) * 12 + (snap,)]
    assert V.health_scores(golden_lake(spark, databases=dbs), AS_OF).count() == 0
    inst = [(1000, "testsrv", "testsrv", "sqlserver", "Q", "a", None, None, None, None, None,
             "integrated", dt.datetime(2026, 5, 27, 9, 0), None)]
    assert V.health_scores(golden_lake(spark, instances=inst), AS_OF).count() == 0


def test_tie_on_collected_at_is_deterministic(spark):
    snap = dt.datetime(2026, 5, 27, 12, 30)
    dbs = [(1000, 7, "sqlserver", "AppDb") + (None,) * 12 + (snap,),
           (1000, 7, "sqlserver", "AppDb_renamed") + (None,) * 12 + (snap,)]
    names = {V.databases_latest(golden_lake(spark, databases=dbs).databases).first().database_name
             for _ in range(3)}
    assert names == {"AppDb_renamed"}  # largest tiebreak wins, every time


def _ping(ts, ok):
    return (1000, "sqlserver", ts, ts.year, ts.month, ts.day, 10 if ok else 5000, ok)


def test_failures_before_last_success_not_counted(spark):
    base = dt.datetime(2026, 5, 27, 10, 0)
    pings = [_ping(base + dt.timedelta(minutes=i), False) for i in range(5)]
    pings.append(_ping(base + dt.timedelta(minutes=10), True))
    pings += [_ping(base + dt.timedelta(minutes=20 + i), False) for i in range(2)]
    lake = golden_lake(spark, pings=pings)
    assert V.unresponsive(lake, AS_OF).count() == 0  # only 2 failures after the success


def test_window_boundaries_are_strict(spark):
    as_of = dt.datetime(2026, 5, 27, 13, 5)
    on_28 = as_of - dt.timedelta(days=28)
    on_4 = as_of - dt.timedelta(days=4)
    # the only success sits exactly on the 28-day boundary -> not in the envelope -> not reported
    pings = [_ping(on_28, True)] + [_ping(as_of - dt.timedelta(hours=i + 1), False) for i in range(3)]
    assert V.unresponsive(golden_lake(spark, pings=pings), AS_OF).count() == 0
    # a failure exactly on the 4-day boundary does not count: 2 inside + 1 on the edge -> not reported
    pings = [_ping(on_4 - dt.timedelta(days=1), True), _ping(on_4, False),
             _ping(as_of - dt.timedelta(hours=2), False), _ping(as_of - dt.timedelta(hours=1), False)]
    assert V.unresponsive(golden_lake(spark, pings=pings), AS_OF).count() == 0
    pings.append(_ping(as_of - dt.timedelta(hours=3), False))
    assert V.unresponsive(golden_lake(spark, pings=pings), AS_OF).first().failed_pings == 3
