"""Fleet telemetry derived from the given input tables.

The run's inputs are generic tables (``events``, ``supplier``, ``lineitem``,
``orders``, ``part``). Each lake table is a deterministic, integer-only
projection of them, so every query's work grows with the inputs. The same
derivations exist as SQL for the DuckDB oracle (``fleetpulse.checks.oracle``).

All derivations are narrow projections/filters except ``metric_database_io``
(a running sum per ``(instance, database, epoch)``, i.e. a shuffle on that key)
and ``databases`` (a distinct).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetpulse import schemas as S
from fleetpulse.functions.scalar import day_t, month_t, ts_lit, year_s
from fleetpulse.sources.driver import read_table

# Fixed values of the derivation (shared with the oracle SQL).
AS_OF = "2024-01-31 00:00:00"
#: Remainders by 50 of the instances that stop answering.
OUTAGE_INSTANCES = (3, 7)
OUTAGE_FROM = "2024-01-28 00:00:00"
SNAPSHOTS = ("2024-01-01 00:00:00", "2024-01-15 00:00:00")
REGISTERED_AT = "2023-12-01 00:00:00"


def _conform(df: DataFrame, schema) -> DataFrame:
    """Select the table's columns in DDL order with DDL types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


class DerivedLake:
    """Lazily derived lake tables over one input folder.

    One instance per (session, folder) is shared (``DerivedLake(spark, dir)``
    returns it), so plans are built once and repeated subtrees are identical.
    """

    _shared: dict = {}

    def __new__(cls, spark: SparkSession, sf_dir: str):
        from fleetpulse.session import session_key

        key = (session_key(spark), sf_dir)
        inst = cls._shared.get(key)
        if inst is None:
            inst = super().__new__(cls)
            inst.spark = spark
            inst.sf_dir = sf_dir
            cls._shared[key] = inst
        return inst

    def __init__(self, spark: SparkSession, sf_dir: str):
        pass

    def base(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # ---------------------------------------------------------------- events
    @cached_property
    def ev(self) -> DataFrame:
        e = self.base("events")
        return e.select(
            "event_id", "ts", "user_id", "event_type", "value",
            (F.lit(1000) + F.floor(F.col("user_id") * 2 / 3)).cast("int").alias("instance_id"),
            (F.lit(4) + F.col("event_id") % 15).cast("int").alias("database_id"),
            F.floor((F.dayofmonth("ts") - 1) / 10).cast("int").alias("ep"),
        )

    def _stamped(self, df: DataFrame, schema, **cols) -> DataFrame:
        """Stamp columns from ``ts`` plus the given measures, in DDL order (one projection)."""
        exprs = {
            "collected_at": F.col("ts"), "platform": F.lit(S_PLATFORM),
            "year": year_s("ts"), "month": month_t("ts"), "day": day_t("ts"),
        }
        exprs.update(cols)
        out = []
        for f in schema.fields:
            e = exprs.get(f.name, F.col(f.name))
            out.append(e.cast(f.dataType).alias(f.name))
        return df.select(*out)

    @cached_property
    def pings(self) -> DataFrame:
        failed = (F.col("event_type") == "error") | (
            (F.col("instance_id") % 50).isin(*OUTAGE_INSTANCES) & (F.col("ts") >= ts_lit(OUTAGE_FROM))
        )
        return self._stamped(
            self.ev, S.PINGS,
            is_success=~failed,
            response_time_ms=F.when(F.col("event_type") == "error", F.lit(5000))
            .otherwise(F.floor("value").cast("int")),
        )

    @cached_property
    def metric_cpu(self) -> DataFrame:
        e = self.ev.filter(F.col("event_type").isin("view", "click"))
        engine = F.when(F.col("event_id") % 53 == 0, F.lit(None)).otherwise((F.col("event_id") * 37) % 90)
        other = (F.col("event_id") * 17) % 11
        return self._stamped(
            e, S.METRIC_CPU,
            engine_cpu_percent=engine, other_cpu_percent=other,
            system_idle_percent=F.lit(100) - engine - other,
        )

    @cached_property
    def metric_memory(self) -> DataFrame:
        e = self.ev.filter(F.col("event_type") == "signup")
        ple = F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise((F.col("event_id") * 7919) % 8000)
        return self._stamped(
            e, S.METRIC_MEMORY,
            page_residency_seconds=ple, buffer_hit_ratio=F.lit(None),
            grants_pending=F.lit(None), grants_outstanding=F.lit(None),
        )

    @cached_property
    def metric_sessions(self) -> DataFrame:
        e = self.ev.filter(F.col("event_type") == "purchase")
        return self._stamped(e, S.METRIC_SESSIONS, active_sessions=F.col("event_id") % 50)

    @cached_property
    def metric_database_io(self) -> DataFrame:
        e = self.ev.filter(F.col("event_type").isin("view", "click"))
        w = Window.partitionBy("instance_id", "database_id", "ep").orderBy("ts", "event_id")
        eid = F.col("event_id")
        reads = F.sum(1 + eid % 97).over(w)
        stall_r = F.sum(1 + eid % 9973).over(w)
        writes = F.sum(1 + eid % 89).over(w)
        stall_w = F.sum(1 + eid % 4999).over(w)
        restart = (
            F.when(eid % 29 == 0, F.lit(None).cast("timestamp_ntz"))
            .when(F.col("ep") == 0, ts_lit("2024-01-01 00:00:00"))
            .when(F.col("ep") == 1, ts_lit("2024-01-11 00:00:00"))
            .otherwise(ts_lit("2024-01-21 00:00:00"))
        )
        e = e.select(
            "*",
            reads.alias("num_of_reads"), stall_r.alias("io_stall_read_ms"),
            writes.alias("num_of_writes"), stall_w.alias("io_stall_write_ms"),
        )
        return self._stamped(
            e, S.METRIC_DATABASE_IO,
            last_restart_at=restart,
            num_of_bytes_read=F.col("num_of_reads") * 8192,
            num_of_bytes_written=F.col("num_of_writes") * 8192,
            io_stall=F.col("io_stall_read_ms") + F.col("io_stall_write_ms"),
            size_on_disk_bytes=F.lit(None),
        )

    @cached_property
    def metric_blocking(self) -> DataFrame:
        e = self.ev.filter(F.col("event_type") == "error")
        return self._stamped(e, S.METRIC_BLOCKING, blocked_session_count=F.col("event_id") % 8)

    # ------------------------------------------------------------ dimensions
    @cached_property
    def instances(self) -> DataFrame:
        s = self.base("supplier")
        k, kind = F.col("s_suppkey"), F.col("s_suppkey") % 10
        fqn = F.lower("s_name")
        df = s.select(
            (F.lit(1000) + k).alias("instance_id"),
            fqn.alias("instance_fqn"),
            fqn.alias("instance_name"),
            F.lit(S_PLATFORM).alias("platform"),
            F.when(kind == 8, "Q").otherwise("P").alias("environment"),
            F.when(kind == 9, "x").when(kind == 4, "b").otherwise("a").alias("status"),
            F.lit("standard").alias("category"),
            F.lit("16.0").alias("engine_version"),
            (k % 3 == 0).alias("is_clustered"),
            F.lit(False).alias("dmz"),
            F.lit("corp").alias("domain"),
            F.lit("integrated").alias("auth_mode"),
            ts_lit(REGISTERED_AT).alias("registered_at"),
            F.lit(None).cast("timestamp_ntz").alias("updated_at"),
        )
        return _conform(df, S.INSTANCES)

    @cached_property
    def registry(self) -> DataFrame:
        """The operational registry: many instances share a dial target."""
        i = self.instances
        host = F.concat(F.lit("host"), (F.col("instance_id") % 7).cast("string"), F.lit(",1433"))
        return _conform(i.withColumn("connect_target", host), S.REGISTRY)

    @cached_property
    def databases(self) -> DataFrame:
        keys = self.ev.select("instance_id", "database_id").distinct()
        db, inst = F.col("database_id"), F.col("instance_id")
        base_name = (
            F.when(db == 4, "msdb")
            .when((db == 6) & (inst % 2 == 0), "uhtdba")
            .when((db == 7) & (inst % 10 == 5), "model")
            .otherwise(F.concat(F.lit("db_"), db.cast("string")))
        )
        snaps = []
        for i, snap in enumerate(SNAPSHOTS):
            name = base_name if i == 0 else F.when(db >= 10, F.concat(base_name, F.lit("_v2"))).otherwise(base_name)
            snaps.append(keys.select(
                inst, db, F.lit(S_PLATFORM).alias("platform"), name.alias("database_name"),
                ts_lit("2023-06-01 00:00:00").alias("create_date"),
                F.lit(160).alias("compatibility_level"),
                F.lit("SQL_Latin1_General_CP1_CI_AS").alias("collation_name"),
                F.when(db % 2 == 0, "FULL").otherwise("SIMPLE").alias("recovery_model"),
                F.lit("ONLINE").alias("state"), F.lit("MULTI_USER").alias("user_access"),
                F.lit(False).alias("is_read_only"), F.lit(False).alias("is_mirrored"),
                F.lit(False).alias("is_alwayson"), F.lit("sa").alias("owner_name"),
                (db * 100).alias("data_file_size_mb"), (db * 10).alias("log_file_size_mb"),
                ts_lit(snap).alias("collected_at"),
            ))
        return _conform(snaps[0].unionByName(snaps[1]), S.DATABASES)

    @cached_property
    def instance_details(self) -> DataFrame:
        """Per-snapshot instance properties (the K7 collection over raw snapshots)."""
        from fleetpulse.plans.packs import instance_details
        from fleetpulse.sources.raw import RawSnapshots

        return instance_details(RawSnapshots(self.spark, self.sf_dir, lake=self))

    @cached_property
    def score_thresholds(self) -> DataFrame:
        return S.thresholds_df(self.spark)

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)


S_PLATFORM = "sqlserver"
