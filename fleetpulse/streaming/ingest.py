"""Collector ingest as a stream (T1, S8, T3, T5): landed JSON to typed rows, quarantine and error rows.

Result files are read with the collector's own column types; a record that does
not fit them keeps its text in ``REJECTED`` (S8). Each micro-batch keeps the
rows of responsive cycles, splits off the rejected ones, turns these into error
rows, and commits all three together under the batch's id (``sources.ledger``):
a batch that is replayed after a lost driver or executor adds nothing, and no
reader sees rows without their rejects.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse import schemas as S
from fleetpulse.operators import joins as J
from fleetpulse.plans import ingest as I
from fleetpulse.plans import scoring as V
from fleetpulse.sources import manifest as M
from fleetpulse.sources.ledger import Ledger

REJECTED = "rejected_record"
QUARANTINE = T.StructType([
    T.StructField("instance_id", S.INT), T.StructField("collected_at", S.TS),
    T.StructField("collector_name", S.STR), T.StructField(REJECTED, S.STR),
])
#: Longest part of a rejected record that its error message repeats (the quarantine holds it whole).
MESSAGE_CHARS = 200


def landed_schema(collector: str) -> T.StructType:
    """What a result file holds: instance, cycle, the collector's query columns in their types, the rejected text."""
    cols = [T.StructField("instance_id", S.INT), T.StructField("collected_at", S.TS)]
    cols += [T.StructField(c, t) for c, t in M.query_columns(collector)]
    return T.StructType([*cols, T.StructField(REJECTED, S.STR)])


def _options(reader):
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", REJECTED)


def read_landed(spark: SparkSession, path: str, collector: str) -> DataFrame:
    """Landed JSON rows, typed; a record with a value that does not fit has its whole text in ``REJECTED``."""
    return _options(spark.read.schema(landed_schema(collector))).json(path)


def read_landed_stream(spark: SparkSession, path: str, collector: str, files_per_trigger: int | None = None) -> DataFrame:
    r = _options(spark.readStream.schema(landed_schema(collector)))
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.json(path)


def split(landed: DataFrame, collector: str, pings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed rows of responsive cycles, quarantine). Records whose instance or time cannot be read are quarantined too,
    though no cycle can be told for them."""
    stamped = landed.withColumn("_cycle", F.date_trunc("second", "collected_at").cast("timestamp_ntz"))
    lost = F.col("instance_id").isNull() | F.col("collected_at").isNull()
    ok = J.semi(stamped.filter(~lost), I.successful_cycles(pings), ["instance_id", "_cycle"]).drop("_cycle")
    good = ok.filter(F.col(REJECTED).isNull()).drop(REJECTED)
    bad = ok.filter(F.col(REJECTED).isNotNull()).unionByName(stamped.filter(lost).drop("_cycle"))
    held = bad.select("instance_id", F.col("collected_at").cast("timestamp_ntz").alias("collected_at"),
                      F.lit(collector).alias("collector_name"), REJECTED)
    return I.stamp_project(I.cycle_stamp(good), collector), held


def reject_rows(quarantine: DataFrame, targets: DataFrame) -> DataFrame:
    """T3 for rejected records: a ``query`` error row each, with the instance's connect target."""
    known = quarantine.filter(F.col("instance_id").isNotNull() & F.col("collected_at").isNotNull())
    named = known.join(targets.select("instance_id", F.col("connect_target").alias("instance_fqn")), "instance_id", "left")
    message = F.concat(F.lit("rejected record: "), F.substring(REJECTED, 1, MESSAGE_CHARS))
    rows = named.select("instance_id", "instance_fqn", "collector_name", "collected_at",
                        F.lit("query").alias("error_type"), message.alias("error_message"))
    return I._conform(I.cycle_stamp(rows), S.COLLECTION_ERRORS)


class CollectorSink:
    """``foreachBatch`` sink of one collector; its ledger and the stream's checkpoint share ``root`` and belong together.

    ``pings``: () -> the ping table, read anew for each batch within the batch's time span.
    """

    def __init__(self, spark: SparkSession, collector: str, root: str, pings, targets: DataFrame):
        self.collector, self.pings, self.targets = collector, pings, targets
        self.ledger = Ledger(spark, root)
        ns, table = next(c for c in M.COLLECTORS if c[0] == collector)[1].split(".")
        self.schema, self.partitions = S.TABLES[(ns, table)]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        run = f"batch-{batch_id}"
        if self.ledger.has(run):
            return  # committed before the stream could note it
        batch = batch.persist()
        try:
            lo, hi = batch.agg(F.min("collected_at"), F.max("collected_at")).first()
            pings = self.pings()
            if lo is not None:  # only the folders of the batch's span
                day = V.partition_date(pings)
                pings = pings if day is None else pings.filter(
                    (day >= F.to_date(F.lit(lo))) & (day <= F.to_date(F.lit(hi))))
            rows, held = split(batch, self.collector, pings)
            held_at = self.ledger.write("quarantine", held)
            stored = batch.sparkSession.read.schema(QUARANTINE).parquet(self.ledger.folder("quarantine", held_at))
            self.ledger.commit(run, {
                "rows": self.ledger.write("rows", rows, self.partitions), "quarantine": held_at,
                "errors": self.ledger.write("errors", reject_rows(stored, self.targets), S.HOT_PARTITIONS),
            })
        finally:
            batch.unpersist()

    def rows(self) -> DataFrame:
        return self.ledger.read("rows", self.schema)

    def quarantine(self) -> DataFrame:
        return self.ledger.read("quarantine", QUARANTINE)

    def errors(self) -> DataFrame:
        return self.ledger.read("errors", S.COLLECTION_ERRORS)


def ingest_stream(spark: SparkSession, landed: DataFrame, sink: CollectorSink, root: str) -> None:
    """Run the ingest of everything landed so far, then stop."""
    q = (
        landed.writeStream.foreachBatch(sink).option("checkpointLocation", os.path.join(root, "checkpoint"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()


# ------------------------------------------------------------------ T5
def tier_triggers(spark: SparkSession) -> dict[str, list[str]]:
    """Cadence -> its enabled collectors (the manifest's 17 rows)."""
    out: dict[str, list[str]] = {}
    for r in M.collectors_df(spark).filter(F.coalesce(F.col("enabled"), F.lit(True))).collect():
        out.setdefault(r.cadence, []).append(r.collector_name)
    return out


class TierSink:
    """``foreachBatch`` sink of one tier: the batch's results summarised per collector and cycle, once per batch id."""

    def __init__(self, spark: SparkSession, cadence: str, root: str):
        self.cadence, self.ledger = cadence, Ledger(spark, root)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        run = f"{self.cadence}-{batch_id}"
        if self.ledger.has(run):
            return
        done = batch.groupBy("collector_name", "collected_at").agg(
            F.sum("n_rows").cast("long").alias("rows_collected"), F.count("error_message").alias("errors"))
        self.ledger.commit(run, {"done": self.ledger.write("done", done.select(F.lit(self.cadence).alias("cadence"), "*"))})


TIER_DONE = T.StructType([
    T.StructField("cadence", S.STR), T.StructField("collector_name", S.STR), T.StructField("collected_at", S.TS),
    T.StructField("rows_collected", S.BIGINT), T.StructField("errors", S.BIGINT),
])


def run_tiers(spark: SparkSession, results, root: str, trigger: dict | None = None) -> dict[str, Ledger]:
    """T5: one stream per cadence tier over one source of results, each with its own checkpoint and trigger.

    ``results``: () -> a streaming DataFrame of result rows. ``trigger`` maps a cadence to trigger options, such as
    ``{"5m": {"processingTime": "5 minutes"}}``; by default every tier takes what is there and stops.
    """
    ledgers, running = {}, []
    for cadence, names in tier_triggers(spark).items():
        own = os.path.join(root, f"tier-{cadence}")
        sink = TierSink(spark, cadence, own)
        ledgers[cadence] = sink.ledger
        w = results().filter(F.col("collector_name").isin(*names)).writeStream.foreachBatch(sink)
        w = w.option("checkpointLocation", os.path.join(own, "checkpoint"))
        running.append(w.trigger(**(trigger or {}).get(cadence, {"availableNow": True})).start())
    for q in running:
        if not trigger:
            q.awaitTermination()
    return ledgers
