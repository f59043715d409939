"""Small in-memory lakes for tests: the hand-computed golden scoring fixture.

One production instance (1000, ``testsrv``) with one user database (7,
``AppDb``) over three closed hours of 2026-05-27. Expected answers are in the
tests.
"""

from __future__ import annotations

import datetime as dt
from types import SimpleNamespace

from pyspark.sql import SparkSession

from fleetpulse import schemas as S


def _t(h: int, m: int = 30) -> dt.datetime:
    return dt.datetime(2026, 5, 27, h, m)


def _stamp(ts: dt.datetime) -> tuple:
    return ("sqlserver", ts, ts.year, ts.month, ts.day)


# Fixed values of the golden fixture (hour -> measures).
CPU = {10: (40, 10, 50), 11: (70, 15, 15), 12: (88, 8, 4)}
PLE = {10: 7200, 11: 1800, 12: 120}
SESSIONS = {10: 100, 11: 100, 12: 100}
IO = {10: (1000, 10000, 1000, 5000), 11: (2000, 30000, 2000, 15000), 12: (3000, 130000, 3000, 40000)}
BLOCKED = {11: 3, 12: 20}
RESTART = dt.datetime(2026, 5, 27, 3, 0)


def golden_lake(spark: SparkSession, **overrides) -> SimpleNamespace:
    inst = [(1000, "testsrv", "testsrv", "sqlserver", "P", "a", None, None, None, None, None,
             "integrated", dt.datetime(2026, 5, 27, 9, 0), None)]
    dbs = [(1000, 7, "sqlserver", "AppDb") + (None,) * 12 + (_t(12),)]
    cpu = [(1000, *_stamp(_t(h)), *v) for h, v in CPU.items()]
    mem = [(1000, *_stamp(_t(h)), v, None, None, None) for h, v in PLE.items()]
    ses = [(1000, *_stamp(_t(h)), v) for h, v in SESSIONS.items()]
    io = []
    for h, (r, sr, w, sw) in IO.items():
        ts = _t(h)
        io.append((1000, 7, "sqlserver", ts, ts.year, ts.month, ts.day, RESTART,
                   r, None, sr, w, None, sw, None, None))
    blk = [(1000, 7, "sqlserver", _t(h), 2026, 5, 27, v) for h, v in BLOCKED.items()]
    tables = {
        "instances": (inst, S.INSTANCES),
        "databases": (dbs, S.DATABASES),
        "metric_cpu": (cpu, S.METRIC_CPU),
        "metric_memory": (mem, S.METRIC_MEMORY),
        "metric_sessions": (ses, S.METRIC_SESSIONS),
        "metric_database_io": (io, S.METRIC_DATABASE_IO),
        "metric_blocking": (blk, S.METRIC_BLOCKING),
        "pings": ([], S.PINGS),
        "score_thresholds": (S.THRESHOLD_SEED, S.SCORE_THRESHOLDS),
    }
    out = {}
    for name, (rows, schema) in tables.items():
        rows = overrides.get(name, rows)
        out[name] = spark.createDataFrame(rows, schema)
    return SimpleNamespace(**out)
