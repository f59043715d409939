"""Ingest and lake maintenance as Spark jobs (S, P1-P3, T1-T4, T9-T13).

Collection results land as files; one lazy plan per collector turns them into
typed, stamped, partitioned Parquet: scan -> responsive-only semi join ->
``try_cast`` with row-level quarantine -> contract projection -> partitioned
append. Maintenance rewrites into a fresh directory and returns it (the caller
swaps the table pointer), so readers never see a half-written table and a
failed job leaves the old version intact.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse import schemas as S
from fleetpulse.functions.scalar import PLATFORM, day_t, month_t, year_s
from fleetpulse.operators import joins as J
from fleetpulse.operators.windows import dense_rank_global
from fleetpulse.session import checkpoint_dir
from fleetpulse.sources import manifest as M

PING_TIMEOUT_SECONDS = 5


# ------------------------------------------------------------------ paths
def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location (never machine-local on a cluster)."""
    return os.path.join(checkpoint_dir(spark), "fleetpulse", f"{name}-{uuid.uuid4().hex[:12]}")


# ------------------------------------------------------------ S1 / S3
def read_lake_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Scan a (partitioned) lake table with its declared schema.

    Supplying the schema keeps SMALLINT/TINYINT partition columns typed (they
    would be inferred as INT); predicates on partition columns prune folders and
    the rest are pushed to the Parquet reader.
    """
    return spark.read.schema(schema).parquet(path)


MAX_RECORDS_PER_FILE = 5_000_000


def by_folder(df: DataFrame, partitions: list[str]) -> DataFrame:
    """Rows rebalanced by folder before a partitioned write: a task writes few folders, so a batch leaves about one file per
    folder instead of one per folder and task; adaptive execution splits a hot folder over many tasks and joins small ones."""
    return df.hint("rebalance", *(F.col(p) for p in partitions)) if partitions else df


def partitioned_append(df: DataFrame, path: str, partitions: list[str],
                       max_records_per_file: int = MAX_RECORDS_PER_FILE) -> None:
    """S3: append ZSTD Parquet partitioned by ``partitions``, bounded file size."""
    w = by_folder(df, partitions).write.mode("append").option("compression", "zstd")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    if partitions:
        w = w.partitionBy(*partitions)
    w.parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Dynamic partition overwrite (only partitions present in ``df`` are replaced)."""
    (
        by_folder(df, partitions).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .partitionBy(*partitions).parquet(path)
    )


# ------------------------------------------------------------ P2 / P3 / P1
def cycle_stamp(df: DataFrame, ts: str = "collected_at") -> DataFrame:
    """The cycle's UTC second-resolution stamp and its partition columns."""
    t = F.date_trunc("second", F.col(ts)).cast("timestamp_ntz")
    return df.withColumn("collected_at", t).select(
        "*", F.lit(PLATFORM).alias("platform"), year_s(t).alias("year"), month_t(t).alias("month"),
        day_t(t).alias("day"),
    )


def typed_coerce(df: DataFrame, columns: list[tuple[str, T.DataType]]) -> tuple[DataFrame, DataFrame]:
    """Coerce each column with ``try_cast``; split off rows that lost a value.

    Returns ``(good, quarantined)``. A row is quarantined when an input value is
    non-NULL but its cast is NULL (overflow or unparsable); NULL stays NULL. This
    keeps one bad value from losing a whole chunk (deliberate improvement).
    """
    bad = None
    casts = []
    for name, typ in columns:
        c = F.col(name)
        lost = c.isNotNull() & c.try_cast(typ).isNull()
        bad = lost if bad is None else bad | lost
        casts.append((name, c.try_cast(typ)))
    flagged = df.withColumn("_bad", bad if bad is not None else F.lit(False))
    good = flagged.filter(~F.col("_bad")).drop("_bad")
    for name, expr in casts:
        good = good.withColumn(name, expr)
    quarantined = flagged.filter(F.col("_bad")).drop("_bad")
    return good, quarantined


def stamp_project(df: DataFrame, collector: str) -> DataFrame:
    """The target row in contract order (stamp / query by name / const NULL)."""
    have = set(df.columns)
    cols = []
    for name, typ, src in M.contract(collector):
        if src == "const" or (src == "stamp" and name not in have) or (src == "query" and name not in have):
            cols.append(F.lit(None).cast(typ).alias(name))
        else:
            cols.append(F.col(name).cast(typ).alias(name))
    return df.select(*cols)


def successful_cycles(pings: DataFrame) -> DataFrame:
    """The (instance, cycle stamp) pairs whose ping succeeded; a cycle's ping and rows share its stamp to the second."""
    return pings.filter("is_success").select(
        "instance_id", F.date_trunc("second", "collected_at").cast("timestamp_ntz").alias("_cycle")
    ).distinct()


def stage(landed: DataFrame, collector: str, pings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """T1 plan up to the write: P10 -> P3 -> P2 -> P1. Returns ``(rows, quarantined)``."""
    cycles = landed.withColumn("_cycle", F.date_trunc("second", "collected_at").cast("timestamp_ntz"))
    responsive = J.semi(cycles, successful_cycles(pings), ["instance_id", "_cycle"]).drop("_cycle")
    good, bad = typed_coerce(responsive, M.query_columns(collector))
    return stamp_project(cycle_stamp(good), collector), bad


def collector_ingest(spark: SparkSession, landed: DataFrame, collector: str, pings: DataFrame,
                     lake_root: str, run: str | None = None) -> tuple[str, DataFrame]:
    """Land one collector's results into its partitioned table; returns (table path, this run's quarantine).

    Rows that fail coercion go to ``<lake_root>/quarantine/<collector>/run=<run>``, which a rerun of the same run
    replaces. The rows are a plain append: ``streaming.ingest`` commits rows, quarantine and errors exactly once.
    """
    rows, bad = stage(landed, collector, pings)
    row = next(c for c in M.COLLECTORS if c[0] == collector)
    ns, table = row[1].split(".")
    path = os.path.join(lake_root, ns, table)
    partitions = S.TABLES[(ns, table)][1]
    partitioned_append(rows, path, partitions)
    held = os.path.join(lake_root, "quarantine", collector, f"run={run or uuid.uuid4().hex}")
    bad.write.mode("overwrite").parquet(held)
    return path, spark.read.schema(bad.schema).parquet(held)


# ------------------------------------------------------------------ T2-T4
def ping_facts(attempts: DataFrame, timeout_seconds: int = PING_TIMEOUT_SECONDS) -> DataFrame:
    """One ping row per instance per cycle; a failure carries ``timeout * 1000`` ms."""
    df = attempts.select(
        "instance_id", "collected_at",
        F.when(F.col("ok"), F.col("elapsed_ms")).otherwise(F.lit(timeout_seconds * 1000)).alias("response_time_ms"),
        F.col("ok").alias("is_success"),
    )
    return _conform(cycle_stamp(df), S.PINGS)


def error_rows(attempts: DataFrame, results: DataFrame) -> DataFrame:
    """A failed connect -> one ``connect`` row (NULL collector); else one ``query`` row
    per failing collector. ``instance_fqn`` carries the connect target (D11)."""
    conn = attempts.filter(~F.col("ok")).select(
        "instance_id", F.col("connect_target").alias("instance_fqn"),
        F.lit(None).cast("string").alias("collector_name"), "collected_at",
        F.lit("connect").alias("error_type"),
        F.lit("connection failed: timeout expired").alias("error_message"),
    )
    ok = attempts.filter("ok").select("instance_id", "collected_at", "connect_target")
    failing = (
        results.filter(F.col("error_message").isNotNull())
        .groupBy("instance_id", "collected_at", "collector_name")
        .agg(F.min("error_message").alias("error_message"))
        .join(ok, ["instance_id", "collected_at"])
        .select("instance_id", F.col("connect_target").alias("instance_fqn"), "collector_name", "collected_at",
                F.lit("query").alias("error_type"), "error_message")
    )
    return _conform(cycle_stamp(conn.unionByName(failing)), S.COLLECTION_ERRORS)


def cycle_summary(attempts: DataFrame, results: DataFrame) -> DataFrame:
    """Per collector and cycle: instances, rows, errors, duration, status error > empty > ok."""
    ok = attempts.filter("ok").select("instance_id", "collected_at")
    r = J.semi(results, ok, ["instance_id", "collected_at"])
    agg = r.groupBy("collector_name", "collected_at").agg(
        F.countDistinct("instance_id").alias("instances"),
        F.sum("n_rows").cast("int").alias("rows_collected"),
        F.count("error_message").alias("errors"),
        F.max("duration_ms").alias("duration_ms"),
    )
    status = F.when(F.col("errors") > 0, "error").when(F.col("rows_collected") == 0, "empty").otherwise("ok")
    return agg.withColumn("status", status)


def cycle_summary_for(spark: SparkSession, attempts: DataFrame, results: DataFrame, cycle=None) -> DataFrame:
    """A12 for one run: every manifest collector appears (no rows -> ``empty``).

    ``cycle`` defaults to the newest cycle in ``attempts`` (a scalar subquery).
    The manifest is a fixed table of 17 collectors, so its join is bounded.
    """
    from fleetpulse.functions.scalar import ts_lit

    at = attempts.select(F.max("collected_at")).scalar() if cycle is None else ts_lit(cycle)
    one = cycle_summary(attempts.filter(F.col("collected_at") == at),
                        results.filter(F.col("collected_at") == at))
    names = M.collectors_df(spark).select("collector_name")
    out = names.join(one, "collector_name", "left")
    return out.select(
        "collector_name", F.coalesce("collected_at", at).alias("collected_at"),
        F.coalesce("instances", F.lit(0)).cast("long").alias("instances"),
        F.coalesce("rows_collected", F.lit(0)).alias("rows_collected"),
        F.coalesce("errors", F.lit(0)).cast("long").alias("errors"),
        "duration_ms", F.coalesce("status", F.lit("empty")).alias("status"),
    )


def cadence_tiers(spark: SparkSession, attempts: DataFrame, results: DataFrame) -> DataFrame:
    """T5 / P9 applied to data: per cadence tier of enabled collectors, the
    collectors that ran and the rows they returned from responsive instances."""
    tiers = M.collectors_df(spark).filter(F.coalesce(F.col("enabled"), F.lit(True))) \
        .select("collector_name", "cadence")
    s = cycle_summary(attempts, results).join(tiers, "collector_name")
    return s.groupBy("cadence").agg(
        F.countDistinct("collector_name").alias("collectors"),
        F.sum("rows_collected").alias("rows_collected"),
        F.sum("errors").alias("errors"),
    )


def collection_log(attempts: DataFrame, results: DataFrame) -> DataFrame:
    """T4: one log row per collector per cycle with ``instance_id`` NULL."""
    s = cycle_summary(attempts, results)
    df = s.select(F.lit(None).cast("int").alias("instance_id"), "collector_name", "collected_at",
                  "rows_collected", "duration_ms", "status")
    return _conform(cycle_stamp(df), S.COLLECTION_LOG)


def _conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


# ------------------------------------------------------------------ T9 / T10
def sync_dimension(spark: SparkSession, path: str, source: DataFrame, out_path: str,
                   keys=("instance_id",)) -> str:
    """Replace-by-key the small dimension at ``path`` from ``source``.

    The merged table is written as a new version at ``out_path`` and the caller
    moves its pointer there: a job lost mid-write leaves the current version
    intact (an in-place overwrite would delete it first).
    """
    target = spark.read.schema(S.INSTANCES).parquet(path)
    merged = J.replace_by_key(target, source, list(keys))
    merged.write.mode("errorifexists").option("compression", "zstd").parquet(out_path)
    return out_path


#: Values of a new registry row that its label does not give (fixed values).
REGISTRY_DEFAULTS = {"platform": "sqlserver", "auth_mode": "integrated", "environment": "P", "status": "a"}


def get_or_create_ids(registry: DataFrame, labels: DataFrame, as_of, first_id: int = 1000) -> DataFrame:
    """The registry after a get-or-create of ``labels``.

    ``labels`` has (instance_fqn, connect_target) and any of the other attributes; a missing or NULL one takes its
    default (the name: the label). A label that exists keeps its id and all attributes but ``connect_target``, which is
    refreshed with ``updated_at``; a new one gets ``max(id)+1..`` in label order. Of rows with one label the least
    counts. New ids are dense from a global rank of the new labels (range-partitioned two-pass offsets, no
    single-task window).
    """
    from fleetpulse.plans.scoring import as_of_col

    given = [f.name for f in registry.schema.fields if f.name in labels.columns and f.name != "instance_fqn"]
    least = labels.filter(F.col("instance_fqn").isNotNull()).groupBy("instance_fqn").agg(F.min(F.struct(*given)).alias("_l"))
    lab = least.select("instance_fqn", *(F.col(f"_l.{c}").alias(c) for c in given))
    base = registry.select(F.coalesce(F.max("instance_id"), F.lit(first_id - 1))).scalar()
    ranked = dense_rank_global(J.anti(lab, registry, ["instance_fqn"]), ["instance_fqn"], "_r").select("instance_fqn", "_r")
    source = lab.join(ranked, "instance_fqn", "left")

    def attribute(name: str):
        value = F.col(f"s.{name}") if name in given else F.lit(None).cast("string")
        default = F.col("s.instance_fqn") if name == "instance_name" else F.lit(REGISTRY_DEFAULTS.get(name))
        return F.coalesce(value, default)

    insert = {"instance_id": base + F.col("s._r"), "instance_fqn": F.col("s.instance_fqn"), "registered_at": as_of_col(as_of),
              **{n: attribute(n) for n in ("instance_name", "platform", "connect_target", "auth_mode", "environment", "status")}}
    update = {"connect_target": F.coalesce(F.col("s.connect_target"), F.col("t.connect_target")), "updated_at": as_of_col(as_of)}
    return J.upsert(registry, source, "instance_fqn", insert, update)


class Registry:
    """T10 as a table: versions in a ledger, ids stable under concurrent runs.

    A run reads the newest version, mints ids on it and commits the next one only if no other run has committed in
    between; otherwise it starts again from the other's result, whose ids it keeps.
    """

    def __init__(self, spark: SparkSession, root: str):
        from fleetpulse.sources.ledger import Ledger

        self.spark, self.ledger = spark, Ledger(spark, root)

    def read(self, record=None) -> DataFrame:
        record = record or self.ledger.newest()
        if record is None:
            return self.spark.createDataFrame([], S.REGISTRY)
        return self.ledger.read_one("registry", record, S.REGISTRY)

    def get_or_create(self, labels: DataFrame, as_of) -> None:
        from fleetpulse.sources.ledger import Conflict

        while True:
            seen = self.ledger.newest()
            made = self.ledger.write("registry", get_or_create_ids(self.read(seen), labels, as_of))
            try:
                return self.ledger.commit(uuid.uuid4().hex, {"registry": made}, after=seen.seq if seen else -1)
            except Conflict:
                continue


def new_labels(registry: DataFrame, generated: DataFrame) -> DataFrame:
    """Generated labels that the registry does not have yet, as rows with the default attributes (each label once);
    the ids come with ``get_or_create_ids``."""
    rows = J.anti(generated.select("instance_fqn", "connect_target").dropDuplicates(["instance_fqn"]), registry, ["instance_fqn"])
    return rows.select("instance_fqn", F.col("instance_fqn").alias("instance_name"), "connect_target",
                       *(F.lit(v).alias(k) for k, v in REGISTRY_DEFAULTS.items()))


# ------------------------------------------------------------------ S7 / S10 / S11
def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header row (one part file per task; read back as a folder)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """Object count and total bytes of the Parquet files under ``path``."""
    df = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("f"),
                                         F.col("_metadata.file_size").alias("b"))
    files = df.groupBy("f").agg(F.max("b").alias("b"))
    return files.agg(F.count(F.lit(1)).alias("objects"), F.sum("b").alias("total_bytes"))
