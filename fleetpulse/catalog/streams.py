"""Registered streaming jobs (T6-T8): each writes its input to a lake folder,
runs the stream to completion (``availableNow``) and reads the sink back."""

from __future__ import annotations

import os


import fleetpulse.catalog.scoring  # noqa: F401  (scoring oracle CTEs)
from fleetpulse import schemas as S
from fleetpulse.catalog import register
from fleetpulse.plans import ingest as I
from fleetpulse.sources.derived import DerivedLake
from fleetpulse.streaming import jobs as J

DELAY = "10 minutes"
#: Of the registered streams; a stream keeps the number of its first run.
STATE_PARTITIONS = 8


def lake(spark, sf_dir) -> DerivedLake:
    return DerivedLake(spark, sf_dir)


@register("hourly_stream", """
SELECT * FROM o_cpu_hourly
WHERE coll_hr + INTERVAL 1 HOUR <= (SELECT max(collected_at) FROM metric_cpu) - INTERVAL 10 MINUTE""")
def q_hourly_stream(spark, sf_dir):
    """Hourly CPU averages as a watermarked stream; only closed hours are emitted."""
    src = I.scratch_path(spark, "cpu_src")
    I.partitioned_append(lake(spark, sf_dir).metric_cpu, src, S.HOT_PARTITIONS)
    work = I.scratch_path(spark, "cpu_stream")
    out = J.hourly_cpu_stream(J.read_stream(spark, src, S.METRIC_CPU, files_per_trigger=16), DELAY)
    J.run_available_now(out, os.path.join(work, "out"), os.path.join(work, "checkpoint"), partitions=STATE_PARTITIONS)
    return spark.read.parquet(os.path.join(work, "out"))


@register("dedup_stream", "SELECT DISTINCT * FROM pings")
def q_dedup_stream(spark, sf_dir):
    """The same batch landed twice; every key is added once, however late it comes again."""
    src = I.scratch_path(spark, "pings_src")
    p = lake(spark, sf_dir).pings
    I.partitioned_append(p, src, S.HOT_PARTITIONS)
    I.partitioned_append(p, src, S.HOT_PARTITIONS)
    work = I.scratch_path(spark, "pings_stream")
    sink = J.DedupSink(spark, work, S.PINGS, ["instance_id", "collected_at"], S.HOT_PARTITIONS)
    J.run_sink(J.read_stream(spark, src, S.PINGS, files_per_trigger=32), sink, os.path.join(work, "checkpoint"))
    return sink.rows()


@register("counter_delta_stream", """
SELECT * FROM o_io_latency
WHERE coll_hr + INTERVAL 1 HOUR <= (SELECT max(collected_at) FROM metric_database_io) - INTERVAL 10 MINUTE""")
def q_counter_delta_stream(spark, sf_dir):
    """IO latency across micro-batches (foreachBatch, newest bucket per key as state)."""
    src = I.scratch_path(spark, "io_src")
    I.partitioned_append(lake(spark, sf_dir).metric_database_io, src, S.HOT_PARTITIONS)
    stream = J.read_stream(spark, src, S.METRIC_DATABASE_IO, files_per_trigger=8)
    return J.counter_delta_stream(spark, stream, I.scratch_path(spark, "io_stream"), DELAY, partitions=STATE_PARTITIONS).latencies()
