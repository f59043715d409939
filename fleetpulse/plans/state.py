"""Materialized scores and latest-state tables, maintained run by run (T13; V13, V14, O3, Q3 at scale).

A run scores the closed hours of ``[start, end)`` and merges what is newest in
that window into two small state tables: one row per instance (newest details,
CPU, non-NULL memory and sessions row) and one per (instance, database) (newest
name and newest scored hour). The state merges by maximum, so merging a window
twice changes nothing, and no reader of the newest state scans history. Scores,
counter state and both tables of a run are committed together
(``sources.ledger``): a run repeated, or lost halfway and repeated, leaves one
copy of every hour, and runs that share a month leave each other's hours alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse import schemas as S
from fleetpulse.plans import scoring as V
from fleetpulse.sources.ledger import Ledger

#: Newest rows kept per instance: column -> (lake table, columns, rows that count).
NEWEST: dict[str, tuple[str, list[str], str | None]] = {
    "details": ("instance_details", ["server_name", "product_version", "logical_cpu_count", "physical_memory_mb"], None),
    "cpu": ("metric_cpu", ["engine_cpu_percent", "other_cpu_percent", "system_idle_percent"], None),
    "memory": ("metric_memory", ["page_residency_seconds"], "page_residency_seconds IS NOT NULL"),
    "sessions": ("metric_sessions", ["active_sessions"], None),
}
DATABASE = ["database_name", "platform"]
#: Lake tables that a run reads.
READS = ("instances", "databases", "metric_cpu", "metric_memory", "metric_sessions", "metric_database_io", "metric_blocking",
         "instance_details", "score_thresholds")
IO_STATE = T.StructType(
    [T.StructField("instance_id", S.INT), T.StructField("database_id", S.INT), T.StructField("coll_hr", S.TS)]
    + [T.StructField(n, S.DOUBLE) for n in V.IO_NAMES]
)


def _struct(table: str, cols: list[str], time: str = "collected_at") -> T.StructType:
    declared = {f.name: f.dataType for ns, t in S.TABLES if t == table for f in S.schema_of(t, ns).fields}
    return T.StructType([T.StructField(time, S.TS)] + [T.StructField(c, declared[c]) for c in cols])


BY_INSTANCE = T.StructType(
    [T.StructField("instance_id", S.INT)] + [T.StructField(n, _struct(t, cols)) for n, (t, cols, _) in NEWEST.items()]
)
#: ``scored`` orders by hour, then by the run that scored it, so a rescored hour replaces its older index.
SCORED = T.StructType([T.StructField("coll_hr", S.TS), T.StructField("seq", S.BIGINT), T.StructField("irc_index", S.TINYINT)])
BY_DATABASE = T.StructType([
    T.StructField("instance_id", S.INT), T.StructField("database_id", S.INT),
    T.StructField("named", _struct("databases", DATABASE)), T.StructField("scored", SCORED),
])


def max_merge(parts: list[DataFrame], keys: list[str], schema: T.StructType) -> DataFrame:
    """One row per key: the largest value of every other column, over parts that each hold some of the columns.

    The columns are structs that begin with a time, so the largest is the newest; NULL is no value. Combines map-side.
    """
    full = [p.select(*[(F.col(f.name) if f.name in p.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
            for p in parts]
    rows = full[0]
    for p in full[1:]:
        rows = rows.unionByName(p)
    values = [f.name for f in schema.fields if f.name not in keys]
    return rows.groupBy(*keys).agg(*[F.max(v).alias(v) for v in values])


def newest_scored(scores: DataFrame, seq: int) -> DataFrame:
    """The newest scored hour per database and its index, as ``SCORED`` of run ``seq``.

    Hour and index are one long until they are grouped, so the scores are hashed and not sorted.
    """
    bits = V.IRC_SLOTS.bit_length() - 1
    packed = F.shiftleft(F.unix_micros(F.col("coll_hr").cast("timestamp")), bits).bitwiseOR(F.col("irc_index").cast("long"))
    hour = F.timestamp_micros(F.shiftright("_p", bits)).cast("timestamp_ntz")
    irc = F.col("_p").bitwiseAND(F.lit(V.IRC_SLOTS - 1).cast("long")).cast("tinyint")
    best = scores.groupBy("instance_id", "database_id").agg(F.max(packed).alias("_p"))
    return best.select("instance_id", "database_id", F.struct(
        hour.alias("coll_hr"), F.lit(seq).cast("long").alias("seq"), irc.alias("irc_index")).alias("scored"))


class ScoreStore:
    """Scores and state at ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.ledger = Ledger(spark, root)

    # ------------------------------------------------------------- write
    def _io_state(self, records: list, start: str) -> DataFrame | None:
        """Counters before ``start``: the state that the newest run ending there left (none before the first run)."""
        for r in reversed(records):
            if r.high == start:
                return self.ledger.read_one("io_state", r, IO_STATE)
        if any(r.low < start for r in records):
            raise ValueError(f"no run ends at {start}; run the hours before it first")
        return None

    def run(self, lake, start: str, end: str) -> None:
        """Score ``[start, end)`` (ISO seconds, on the hour) and merge the window into the state. Rerunnable."""
        records = self.ledger.records()
        last = records[-1] if records else None
        seq = last.seq + 1 if last else 0
        scores, io_state = V.score_increment(lake, start, end, self._io_state(records, start))
        folders = {"scores": self.ledger.write("scores", scores, S.SCORE_PARTITIONS),
                   "io_state": self.ledger.write("io_state", io_state)}

        def window(df: DataFrame) -> DataFrame:
            return V.time_bound(df, lo=V.as_of_col(start), hi=V.as_of_col(end), lo_strict=False)

        newest = []
        for name, (table, cols, where) in NEWEST.items():
            rows = window(getattr(lake, table))
            rows = rows if where is None else rows.filter(where)
            newest.append(rows.groupBy("instance_id").agg(F.max(F.struct("collected_at", *cols)).alias(name)))
        # the rows just written, not the plan that made them
        written = self.spark.read.schema(S.HEALTH_SCORES).parquet(self.ledger.folder("scores", folders["scores"]))
        databases = [
            window(lake.databases).groupBy("instance_id", "database_id").agg(F.max(F.struct("collected_at", *DATABASE)).alias("named")),
            newest_scored(written, seq),
        ]
        if last is not None:
            newest.append(self.ledger.read_one("by_instance", last, BY_INSTANCE))
            databases.append(self.ledger.read_one("by_database", last, BY_DATABASE))
        folders["by_instance"] = self.ledger.write("by_instance", max_merge(newest, ["instance_id"], BY_INSTANCE))
        folders["by_database"] = self.ledger.write(
            "by_database", max_merge(databases, ["instance_id", "database_id"], BY_DATABASE))
        self.ledger.commit(f"{start}/{end}", folders, start, end)

    def remove_dead(self) -> int:
        """Delete what no reader takes any more: replaced scores, older state."""
        return self.ledger.remove_dead(newest_only=("by_instance", "by_database"))

    # -------------------------------------------------------------- read
    def scores(self) -> DataFrame:
        """Every scored hour once, from the newest run that covers it."""
        return self.ledger.read("scores", S.HEALTH_SCORES, "coll_hr")

    def _newest(self, part: str, schema: T.StructType) -> DataFrame:
        last = self.ledger.newest()
        if last is None:
            return self.spark.createDataFrame([], schema)
        return self.ledger.read_one(part, last, schema)

    def by_instance(self) -> DataFrame:
        return self._newest("by_instance", BY_INSTANCE)

    def by_database(self) -> DataFrame:
        return self._newest("by_database", BY_DATABASE)


def high_irc(store: ScoreStore, instances: DataFrame) -> DataFrame:
    """V13 from the state: the newest scored hour of every instance's eligible databases, worst index >= 2.

    Eligibility is judged now, on the newest names and the instance's status, as the full chain does.
    """
    named = store.by_database().filter("named IS NOT NULL AND scored IS NOT NULL").select(
        "instance_id", "database_id", F.col("named.database_name").alias("database_name"), "scored")
    live = V.eligible_filter(named.join(instances.select("instance_id", "status", "environment"), "instance_id"))
    hour, irc = F.col("scored.coll_hr"), F.col("scored.irc_index")
    worst = live.groupBy("instance_id").agg(F.max(F.struct(hour.alias("coll_hr"), irc.alias("irc_index"))).alias("w"))
    return worst.filter(F.col("w.irc_index") >= V.HIGH_IRC_MIN).select(
        "instance_id", F.col("w.coll_hr").alias("latest_coll_hr"), F.col("w.irc_index").alias("irc_index"))


def problematic_instances(store: ScoreStore, lake, as_of, ordered: bool = True) -> DataFrame:
    """V14 from the state and the 28-day ping window."""
    return V.assemble_problematic(V.unresponsive(lake, as_of), high_irc(store, lake.instances), lake.instances, ordered)


def instance_detail(store: ScoreStore, instances: DataFrame, instance_fqn: str | None = None) -> DataFrame:
    """Q3 (O3) from the state: newest row of every kind and the distinct database count, one row per instance."""
    inst = instances.select("instance_id", "instance_fqn")
    if instance_fqn is not None:
        inst = inst.filter(F.col("instance_fqn") == instance_fqn)
    counts = store.by_database().filter("named IS NOT NULL").groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("database_count"))

    def flat(name: str) -> list[Column]:
        cols = NEWEST[name][1]
        return [F.col(f"{name}.collected_at").alias(f"{name}_collected_at"), *(F.col(f"{name}.{c}").alias(c) for c in cols)]

    return (
        inst.join(store.by_instance(), "instance_id", "left").join(counts, "instance_id", "left")
        .select("instance_id", "instance_fqn", *(c for n in NEWEST for c in flat(n)), "database_count")
    )
