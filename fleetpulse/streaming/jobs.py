"""Structured Streaming forms of the hourly aggregates, de-duplication and
counter deltas (T6-T8).

Sources are lake folders read with ``readStream`` and a declared schema; event
time is ``collected_at`` cast to TIMESTAMP (watermarks need the zoned type; the
session zone is UTC so wall-clock values are unchanged). Sinks are file sinks
or ``foreachBatch`` with checkpoints in the shared checkpoint folder, so a
restarted query resumes exactly where it stopped. ``foreachBatch`` sinks commit
each batch once (``sources.ledger``); a sink's ledger and its stream's
checkpoint belong together.
"""

from __future__ import annotations

import contextlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse import schemas as S
from fleetpulse.operators import joins as J
from fleetpulse.plans import scoring as V
from fleetpulse.sources.ledger import Ledger


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def with_event_time(df: DataFrame, delay: str, col: str = "collected_at") -> DataFrame:
    return df.withColumn("_t", F.col(col).cast("timestamp")).withWatermark("_t", delay)


@contextlib.contextmanager
def state_partitions(spark: SparkSession, n: int | None):
    """Number of state partitions of the queries started inside.

    The first run of a stream fixes it in the checkpoint, so it is sized for the stream's life (about the executors'
    cores), not taken from whatever the session's batch shuffles use.
    """
    old = spark.conf.get("spark.sql.shuffle.partitions")
    if n:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def run_available_now(df: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet", partitions: int | None = None) -> None:
    """Process everything available, then stop (append mode, file sink)."""
    w = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    with state_partitions(df.sparkSession, partitions):
        q = w.trigger(availableNow=True).start(sink_path)
    q.awaitTermination()


# ----------------------------------------------------------------- T6
def hourly_cpu_stream(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Closed-hour CPU averages per instance; append mode emits an hour once the
    watermark passes its end (the newest, still-filling hour is never emitted)."""
    s = with_event_time(stream, delay)
    agg = s.groupBy(F.window("_t", "1 hour"), "instance_id").agg(
        F.avg("engine_cpu_percent").alias("avg_engine_cpu"),
        F.avg("other_cpu_percent").alias("avg_other_cpu"),
        F.avg("system_idle_percent").alias("avg_idle_cpu"),
    )
    return agg.select("instance_id", F.col("window.start").cast("timestamp_ntz").alias("coll_hr"),
                      "avg_engine_cpu", "avg_other_cpu", "avg_idle_cpu")


# ----------------------------------------------------------------- T7
def dedup_stream(stream: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Drop re-delivered rows with the same key within the watermark delay; the state holds ``delay`` of keys."""
    s = with_event_time(stream, delay)
    return s.dropDuplicatesWithinWatermark(keys + ["_t"]).drop("_t")


class DedupSink:
    """T7 without state (``foreachBatch``): a batch adds the rows whose key the sink does not hold yet.

    The sink itself is what is known, however late a row is delivered again: J8 reads only the folders that the batch
    touches and shuffles only the rows that pass the batch's key filter.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: list[str], partitions: list[str]):
        self.schema, self.keys, self.partitions = schema, keys, partitions
        self.ledger = Ledger(spark, root)

    def rows(self) -> DataFrame:
        return self.ledger.read("rows", self.schema)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        run = f"batch-{batch_id}"
        if self.ledger.has(run):
            return
        batch = batch.persist()  # read for folders, key filter and rows
        try:
            new = J.insert_if_absent(batch, self.rows(), self.keys, self.partitions)
            self.ledger.commit(run, {"rows": self.ledger.write("rows", new, self.partitions)})
        finally:
            batch.unpersist()


def run_sink(stream: DataFrame, sink, checkpoint: str, partitions: int | None = None) -> None:
    """Run a ``foreachBatch`` sink over everything available, then stop."""
    w = stream.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint)
    with state_partitions(stream.sparkSession, partitions):
        q = w.trigger(availableNow=True).start()
    q.awaitTermination()


# ----------------------------------------------------------------- T8
def io_buckets_stream(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """T8 step 1: restart-hour filter and closed hourly counter averages (append mode)."""
    s = V.restart_hour_filter(with_event_time(stream, delay))
    agg = s.groupBy(F.window("_t", "1 hour"), "instance_id", "database_id").agg(
        *[F.avg(c).alias(out) for c, out in V.IO_COUNTERS]
    )
    return agg.select("instance_id", "database_id", F.col("window.start").cast("timestamp_ntz").alias("coll_hr"),
                      *V.IO_NAMES)


LATENCY = T.StructType([
    T.StructField("instance_id", S.INT), T.StructField("database_id", S.INT), T.StructField("coll_hr", S.TS),
    T.StructField("read_latency_ms", S.BIGINT), T.StructField("write_latency_ms", S.BIGINT),
])
BUCKET = T.StructType([*LATENCY.fields[:3], *(T.StructField(n, S.DOUBLE) for n in V.IO_NAMES)])


class CounterDeltaSink:
    """T8 step 2 (``foreachBatch``): the batch view's lag rule (``io_latency_seeded``) across micro-batches.

    The state is the newest closed bucket per (instance, database): one row per key, and only of keys heard of within
    ``keep_days`` of the newest bucket (None: all), so its size is bounded by the keys in use. A key that returns after
    longer starts anew, as if first seen. Latencies and next state of a batch are committed together; a replayed batch
    adds nothing, and a state version goes as soon as the next one is committed.
    """

    def __init__(self, spark: SparkSession, root: str, keep_days: int | None = None):
        self.keep_days = keep_days
        self.ledger = Ledger(spark, root)

    def latencies(self) -> DataFrame:
        return self.ledger.read("latency", LATENCY)

    def state(self) -> DataFrame | None:
        last = self.ledger.newest()
        return self.ledger.read_one("state", last, BUCKET) if last else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        run = f"batch-{batch_id}"
        if self.ledger.has(run):
            return
        batch = batch.persist()  # written to two places; computed once
        try:
            latency, state = V.io_latency_seeded(batch, self.state())
            if self.keep_days is not None:
                newest = state.select(F.max("coll_hr")).scalar()
                state = state.filter(F.col("coll_hr") >= newest - F.make_dt_interval(F.lit(self.keep_days)))
            self.ledger.commit(run, {"latency": self.ledger.write("latency", latency), "state": self.ledger.write("state", state)})
        finally:
            batch.unpersist()
        self.ledger.remove_dead(newest_only=("state",))


def counter_delta_stream(spark: SparkSession, stream: DataFrame, root: str, delay: str = "10 minutes",
                         keep_days: int | None = None, partitions: int | None = None) -> CounterDeltaSink:
    sink = CounterDeltaSink(spark, root, keep_days)
    run_sink(io_buckets_stream(stream, delay), sink, os.path.join(root, "checkpoint"), partitions)
    return sink
