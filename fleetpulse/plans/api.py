"""Read API (Q1-Q5) as DataFrame functions.

The reference answers one instance at a time from a server process; here each
call is a lazy DataFrame over the whole lake, and the per-instance form is a
filter on the fleet-wide answer (so one plan serves a dashboard of all
instances as well).
"""

from __future__ import annotations

import contextlib
import itertools
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.functions.scalar import minus_days, minus_hours
from fleetpulse.operators import joins as J
from fleetpulse.operators.windows import latest_per_key
from fleetpulse.plans import scoring as V

MAX_TOPK = 200
DEFAULT_TOPK = 25
MAX_HOURS = 720
DEFAULT_ROWS = 500
MAX_ROWS = 5000

METRICS = {
    "cpu": ("metric_cpu", ["engine_cpu_percent", "other_cpu_percent", "system_idle_percent"]),
    "memory": ("metric_memory", ["page_residency_seconds"]),
    "sessions": ("metric_sessions", ["active_sessions"]),
}


def list_instances(instances: DataFrame, platform: str | None = None) -> DataFrame:
    """Q1 (O5): registered instances, optionally one platform, ordered by label."""
    df = instances if platform is None else instances.filter(F.col("platform") == platform)
    return df.select(
        "instance_fqn", "platform", "status", "environment", "engine_version", "registered_at"
    ).orderBy("instance_fqn")


def active_fleet(registry: DataFrame, platform: str, ids=None, limit: int = 100_000) -> DataFrame:
    """The registry's active instances of one platform (optionally an id list), ordered, limited.

    Collection uses status ``a`` only, while scoring accepts ``a`` and ``b`` (D12).
    """
    df = registry.filter((F.col("status") == "a") & (F.col("platform") == platform))
    if ids:
        df = df.filter(F.col("instance_id").isin(*[int(i) for i in ids]))
    return df.orderBy("instance_id").limit(int(limit)).select("instance_id", "connect_target", "auth_mode", "platform")


def problematic_topk(lake, as_of, limit: int = DEFAULT_TOPK) -> DataFrame:
    """Q2 (O2): the worst ``limit`` problematic instances; sort and limit in one plan."""
    if not 1 <= int(limit) <= MAX_TOPK:
        raise ValueError(f"limit must be in 1..{MAX_TOPK}")
    return V.problematic_instances(lake, as_of).limit(int(limit))


RECENT_DAYS = 2


def _latest(df: DataFrame, cols: list[str], prefix: str) -> DataFrame:
    out = latest_per_key(
        df.select("instance_id", "collected_at", *cols), ["instance_id"], ["collected_at"], tiebreak=cols
    )
    return out.select("instance_id", F.col("collected_at").alias(f"{prefix}_collected_at"), *cols)


def latest_recent_first(df: DataFrame, cols: list[str], prefix: str, instances: DataFrame, as_of,
                        days: int = RECENT_DAYS) -> DataFrame:
    """O3: newest row per instance, reading the last ``days`` first.

    An instance with any row newer than ``as_of - days`` has its newest row
    there, so only instances without one fall back to their full history
    (semi-join on that small set). The recent scan is folder-pruned on a stored
    lake; when every instance reported recently the fallback's build side is
    empty and AQE removes that branch.
    """
    lo = minus_days(V.as_of_col(as_of), days)
    df = df.filter(F.col("collected_at") <= V.as_of_col(as_of))
    recent = _latest(V.time_bound(df, lo=lo), cols, prefix)
    missing = J.anti(instances.select("instance_id"), recent, ["instance_id"])
    older = _latest(J.semi(df, missing, ["instance_id"]), cols, prefix)
    return recent.unionByName(older)


def instance_detail(lake, instance_fqn: str | None = None, as_of=None) -> DataFrame:
    """Q3: latest details, CPU, non-NULL PLE and sessions, and distinct database count.

    Fleet-wide: every instance gets one row; passing ``instance_fqn`` filters to
    that label. An unknown label yields an empty result (the caller reports
    "no instance"). With ``as_of`` the latest rows are found recent-window first.
    """
    inst = lake.instances.select("instance_id", "instance_fqn")
    if instance_fqn is not None:
        inst = inst.filter(F.col("instance_fqn") == instance_fqn)

    def latest(df, cols, prefix):
        if as_of is None:
            return _latest(df, cols, prefix)
        return latest_recent_first(df, cols, prefix, inst, as_of)

    det = latest(lake.instance_details, ["server_name", "product_version", "logical_cpu_count",
                                         "physical_memory_mb"], "details")
    cpu = latest(lake.metric_cpu, ["engine_cpu_percent", "other_cpu_percent", "system_idle_percent"], "cpu")
    mem = latest(lake.metric_memory.filter(F.col("page_residency_seconds").isNotNull()),
                 ["page_residency_seconds"], "memory")
    ses = latest(lake.metric_sessions, ["active_sessions"], "sessions")
    dbs = lake.databases.groupBy("instance_id").agg(F.countDistinct("database_id").alias("database_count"))
    return (
        inst.join(det, "instance_id", "left")
        .join(cpu, "instance_id", "left")
        .join(mem, "instance_id", "left")
        .join(ses, "instance_id", "left")
        .join(dbs, "instance_id", "left")
    )


def metric_history(lake, instance_fqn: str, metric: str, hours: int, as_of) -> DataFrame:
    """Q4 (J7 + P8 + O4): one instance's series over the trailing ``hours``.

    Memory keeps rows whose PLE is NULL (unlike Q3).
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {sorted(METRICS)}")
    if not 1 <= int(hours) <= MAX_HOURS:
        raise ValueError(f"hours must be in 1..{MAX_HOURS}")
    table, cols = METRICS[metric]
    lo = minus_hours(V.as_of_col(as_of), int(hours))
    inst = lake.instances.filter(F.col("instance_fqn") == instance_fqn).select("instance_id")
    m = getattr(lake, table)
    return (
        m.join(inst, "instance_id")
        .filter((F.col("collected_at") >= lo) & (F.col("collected_at") <= V.as_of_col(as_of)))
        .select("collected_at", *cols)
        .orderBy("collected_at")
    )


_READ_ONLY = re.compile(r"^(select|with)\b", re.IGNORECASE)


def check_query_text(sql: str) -> str:
    """P12 gates: one ``SELECT``/``WITH`` statement (a trailing ``;`` is dropped)."""
    trimmed = re.sub(r";\s*$", "", sql.strip())
    if not _READ_ONLY.match(trimmed):
        raise ValueError("only SELECT/WITH queries are allowed")
    if ";" in trimmed:
        raise ValueError("single statement only")
    return trimmed


def run_query(spark: SparkSession, sql: str, limit: int = DEFAULT_ROWS) -> DataFrame:
    """Run one read-only query over the registered views, bounded by LIMIT."""
    if not 1 <= int(limit) <= MAX_ROWS:
        raise ValueError(f"limit must be in 1..{MAX_ROWS}")
    # As a subquery, so that a statement that writes (INSERT behind a WITH) does not parse.
    return spark.sql(f"SELECT * FROM (\n{check_query_text(sql)}\n) AS q LIMIT {int(limit)}")


@contextlib.contextmanager
def views(spark: SparkSession, lake, names):
    """Lake tables as session views for the queries analysed inside; they are gone afterwards (a plan keeps its tables)."""
    for n in names:
        getattr(lake, n).createOrReplaceTempView(n)
    try:
        yield
    finally:
        for n in names:
            spark.catalog.dropTempView(n)


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON text. Integers beyond +-(2^53-1) become strings (JSON
    numbers lose precision there); timestamps are rendered as strings; NULL stays null.
    """
    limit = 2**53 - 1
    parts: list = []
    for is_long, fields in itertools.groupby(df.schema.fields, key=lambda f: f.dataType.typeName() == "long"):
        if is_long:
            for f in fields:
                c = F.col(f.name)
                text = c.cast("string")
                wide = (c > F.lit(limit)) | (c < F.lit(-limit))
                value = F.when(wide, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)
                parts.append(F.concat(F.lit(f"{json.dumps(f.name)}:"), F.coalesce(value, F.lit("null"))))
        else:  # neighbouring columns of other kinds in one piece, without its braces
            one = F.to_json(F.struct(*(F.col(f.name) for f in fields)), {"ignoreNullFields": "false"})
            parts.append(F.substring(one, F.lit(2), F.length(one) - 2))
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("json"))
