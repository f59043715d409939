"""Health scoring: the read-side view chain (V1-V14) as DataFrame functions.

Each function takes lake DataFrames (anything with the table attributes, e.g.
``DerivedLake`` or ``Lake``) and an ``as_of`` UTC instant, and returns a lazy
DataFrame. Composed, they form one logical plan for Catalyst.

Plan shape at scale:
* every telemetry stream is aggregated to the hour (partial + final aggregate)
  before any join, so joins see one row per instance-hour or database-hour;
* dimensions (eligible databases, instances) are small and broadcast below the
  AQE threshold; the hourly aggregates are joined on their full keys;
* the IO counter chain shuffles the hourly aggregate (not raw rows) to the
  ``(instance, database)`` window;
* an upper time bound equal to the closed-hour cut is applied on the raw
  ``collected_at`` so Parquet min/max statistics can skip row groups.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.scalar import (
    band_index, floor_ratio, hour_bucket, minus_days, month_t, round_half_even_cast, safe_div,
    ts_lit, year_s,
)
from fleetpulse.operators.windows import (
    all_nonzero, lag_with_default, latest_per_key, reset_guarded_delta,
)

SYSTEM_DATABASES = ("master", "tempdb", "model", "msdb", "uhtdba")
ACTIVE_STATUSES = ("a", "b")
HIGH_IRC_MIN = 2
FAILED_PINGS_MIN = 3
PING_ENVELOPE_DAYS = 28
FAILURE_WINDOW_DAYS = 4
INDEXES = ("cpu", "memory", "read_latency", "write_latency", "blocker")


def reuse_plan(fn):
    """Memoize a lake-level plan per (lake, as_of, options).

    DataFrames are immutable lazy plans, so queries that share a sub-plan (the
    scoring chain feeds the roll-up, the high-IRC check and the flagship) build
    it once per session; Python-side construction and eager analysis are paid
    once. Calls with DataFrame arguments or a Column ``as_of`` are not memoized.
    """

    @functools.wraps(fn)
    def wrapper(lake, as_of, *args, **kwargs):
        plain = all(v is None or isinstance(v, (bool, int, str)) for v in kwargs.values())
        if args or isinstance(as_of, Column) or not plain:
            return fn(lake, as_of, *args, **kwargs)
        store = lake.__dict__.setdefault("_plan_memo", {})
        key = (fn.__name__, as_of, tuple(sorted(kwargs.items())))
        if key not in store:
            store[key] = fn(lake, as_of, **kwargs)
        return store[key]

    return wrapper


def as_of_col(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else ts_lit(as_of)


def closed_hour_cut(as_of) -> Column:
    """P7 bound: ``date_trunc('hour', as_of)``."""
    return hour_bucket(as_of_col(as_of))


# --------------------------------------------------------------------- V1/V2
def databases_latest(databases: DataFrame) -> DataFrame:
    """V1: newest snapshot per (instance_id, database_id)."""
    return latest_per_key(
        databases.select("instance_id", "database_id", "platform", "database_name", "collected_at"),
        keys=["instance_id", "database_id"],
        order=["collected_at"],
        tiebreak=["database_name", "platform"],
    )


def eligible_filter(df: DataFrame) -> DataFrame:
    """Production, active, user databases."""
    return df.filter(
        F.col("status").isin(*ACTIVE_STATUSES)
        & (F.col("environment") == "P")
        & (F.col("database_id") > 4)
        & ~F.col("database_name").isin(*SYSTEM_DATABASES)
    )


def eligible_databases(databases: DataFrame, instances: DataFrame) -> DataFrame:
    """V2: V1 joined to the instance dimension (J1) and filtered."""
    dl = databases_latest(databases)
    inst = instances.select("instance_id", "status", "environment")
    joined = dl.join(inst, "instance_id")
    return eligible_filter(joined).select("instance_id", "database_id", "platform", "database_name")


# ----------------------------------------------------------------- V3 .. V7
def partition_date(df: DataFrame):
    """The folder date of a lake row, from its ``year/month/day`` partition columns."""
    if not {"year", "month", "day"} <= set(df.columns):
        return None
    return F.make_date(F.col("year").cast("int"), F.col("month").cast("int"), F.col("day").cast("int"))


def time_bound(df: DataFrame, lo=None, hi=None, lo_strict: bool = True) -> DataFrame:
    """Bound ``collected_at`` to (lo, hi) and add the implied folder-date bounds.

    The folder predicate is redundant for the result but lets a partitioned
    lake skip whole ``year/month/day`` folders (it references only partition
    columns); the ``collected_at`` predicate is pushed to Parquet statistics.
    """
    t = F.col("collected_at")
    d = partition_date(df)
    if lo is not None:
        df = df.filter(t > lo if lo_strict else t >= lo)
        if d is not None:
            df = df.filter(d >= F.to_date(lo))
    if hi is not None:
        df = df.filter(t < hi)
        if d is not None:
            df = df.filter(d <= F.to_date(hi))
    return df


def _bounded(df: DataFrame, as_of, bound: bool) -> DataFrame:
    # date_trunc('hour', t) < H  <=>  t < H when H is on the hour: a pushable,
    # statistics-friendly form of the closed-hour cut.
    return time_bound(df, hi=closed_hour_cut(as_of)) if bound else df


def cpu_hourly(metric_cpu: DataFrame, as_of=None) -> DataFrame:
    """V3 (A1): hourly CPU averages per instance."""
    src = _bounded(metric_cpu, as_of, as_of is not None)
    return src.groupBy("instance_id", hour_bucket("collected_at").alias("coll_hr")).agg(
        F.avg("engine_cpu_percent").alias("avg_engine_cpu"),
        F.avg("other_cpu_percent").alias("avg_other_cpu"),
        F.avg("system_idle_percent").alias("avg_idle_cpu"),
    )


def memory_hourly(metric_memory: DataFrame, as_of=None) -> DataFrame:
    """V4 (P5 + A1): hourly page life expectancy, PLE rows only."""
    src = _bounded(metric_memory, as_of, as_of is not None)
    return (
        src.filter(F.col("page_residency_seconds").isNotNull())
        .groupBy("instance_id", hour_bucket("collected_at").alias("coll_hr"))
        .agg(F.avg("page_residency_seconds").alias("avg_ple_sec"))
    )


def sessions_hourly(metric_sessions: DataFrame, as_of=None) -> DataFrame:
    """V5 (A1): hourly active sessions."""
    src = _bounded(metric_sessions, as_of, as_of is not None)
    return src.groupBy("instance_id", hour_bucket("collected_at").alias("coll_hr")).agg(
        F.avg("active_sessions").alias("avg_active_sessions")
    )


IO_COUNTERS = (
    ("num_of_reads", "num_of_reads"),
    ("io_stall_read_ms", "io_wait_read_ms"),
    ("num_of_writes", "num_of_writes"),
    ("io_stall_write_ms", "io_wait_write_ms"),
)
IO_NAMES = [out for _, out in IO_COUNTERS]


def restart_hour_filter(df: DataFrame) -> DataFrame:
    """Drop rows in the restart's hour and rows with no restart stamp."""
    return df.filter(
        F.col("last_restart_at").isNotNull()
        & (hour_bucket("collected_at") != hour_bucket("last_restart_at"))
    )


def io_bucketed(metric_database_io: DataFrame, as_of=None) -> DataFrame:
    """V6 step 1 (P6 + A2): hourly average of the cumulative counters."""
    src = restart_hour_filter(_bounded(metric_database_io, as_of, as_of is not None))
    return src.groupBy(
        "instance_id", "database_id", hour_bucket("collected_at").alias("coll_hr")
    ).agg(*[F.avg(c).alias(out) for c, out in IO_COUNTERS])


def io_lagged(metric_database_io: DataFrame, as_of=None) -> DataFrame:
    """V6 step 2 (W2): previous existing bucket's counters, default 0."""
    return lag_with_default(
        io_bucketed(metric_database_io, as_of), ["instance_id", "database_id"], "coll_hr", IO_NAMES, 0
    )


def io_deltas(metric_database_io: DataFrame, as_of=None) -> DataFrame:
    """V6 step 3 (W4 + W3): all lags present, reset-guarded deltas."""
    lagged = io_lagged(metric_database_io, as_of)
    return lagged.filter(all_nonzero([f"lag_{c}" for c in IO_NAMES])).select(
        "instance_id", "database_id", "coll_hr",
        *[reset_guarded_delta(c, f"lag_{c}").alias(c) for c in IO_NAMES],
    )


def io_latency_hourly(metric_database_io: DataFrame, as_of=None) -> DataFrame:
    """V6 (W5): per-operation latency from counter deltas."""
    d = io_deltas(metric_database_io, as_of)
    return d.filter((F.col("num_of_reads") != 0) & (F.col("num_of_writes") != 0)).select(
        "instance_id", "database_id", "coll_hr",
        floor_ratio("io_wait_read_ms", "num_of_reads").alias("read_latency_ms"),
        floor_ratio("io_wait_write_ms", "num_of_writes").alias("write_latency_ms"),
    )


def blocking_hourly(metric_blocking: DataFrame, as_of=None) -> DataFrame:
    """V7 (A3): hourly peak of blocked sessions per database."""
    src = _bounded(metric_blocking, as_of, as_of is not None)
    return src.groupBy(
        "instance_id", "database_id", hour_bucket("collected_at").alias("coll_hr")
    ).agg(F.max("blocked_session_count").alias("max_blocking_sessions"))


# ------------------------------------------------------------------- V10
def threshold_pivot(score_thresholds: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A4: the rule table as one row of 15 scalars (direction, warn, crit per index), or one row per ``keys`` where rules
    differ (by instance, say)."""
    aggs = []
    for name in INDEXES:
        hit = F.col("index_name") == name
        aggs += [
            F.max(F.when(hit, F.col("direction"))).alias(f"{name}_dir"),
            F.max(F.when(hit, F.col("warn_threshold"))).alias(f"{name}_warn"),
            F.max(F.when(hit, F.col("crit_threshold"))).alias(f"{name}_crit"),
        ]
    return score_thresholds.groupBy(*keys).agg(*aggs)


def threshold_scalars(score_thresholds: DataFrame) -> Column:
    """J4 without a cross join: the one-row pivot as a single struct scalar subquery.

    A global aggregate has exactly one row, so the bound is proven; Spark runs
    the subquery once and inlines its value into the scoring projection.
    """
    piv = threshold_pivot(score_thresholds)
    return piv.select(F.struct(*piv.columns).alias("th")).scalar()


def join_health_base(ed: DataFrame, cpu: DataFrame, mem: DataFrame, ses: DataFrame, io: DataFrame,
                     blk: DataFrame) -> DataFrame:
    """V10 base from its hourly components: eligible databases x CPU hours (J2),
    four left joins (J3). Instance-level measures are joined at instance-hour
    grain, before the fan-out to databases multiplies the rows; per-database
    ones after it."""
    inst_hr = cpu.join(mem, ["instance_id", "coll_hr"], "left").join(ses, ["instance_id", "coll_hr"], "left")
    base = (
        inst_hr.join(ed, "instance_id")
        .join(io, ["instance_id", "database_id", "coll_hr"], "left")
        .join(blk, ["instance_id", "database_id", "coll_hr"], "left")
    )
    blocking = F.coalesce(F.col("max_blocking_sessions"), F.lit(0))
    return base.select(
        "instance_id", "database_id", "platform", "coll_hr",
        "avg_engine_cpu", "avg_other_cpu", "avg_idle_cpu", "avg_ple_sec", "avg_active_sessions",
        "read_latency_ms", "write_latency_ms",
        blocking.alias("max_blocking_sessions"),
        (F.col("avg_engine_cpu") + F.col("avg_other_cpu")).alias("cpu_busy_pct"),
        safe_div(blocking, "avg_active_sessions").alias("blocker_ratio"),
    )


@reuse_plan
def health_base(lake, as_of) -> DataFrame:
    """V10 base over all history up to the closed-hour cut."""
    cpu = cpu_hourly(lake.metric_cpu, as_of).filter(F.col("coll_hr") < closed_hour_cut(as_of))
    return join_health_base(
        eligible_databases(lake.databases, lake.instances), cpu,
        memory_hourly(lake.metric_memory, as_of), sessions_hourly(lake.metric_sessions, as_of),
        io_latency_hourly(lake.metric_database_io, as_of), blocking_hourly(lake.metric_blocking, as_of),
    )


HEALTH_COLUMNS = [
    "instance_id", "database_id", "platform", "coll_hr", "year", "month", "sql_cpu", "idl_cpu",
    "oth_cpu", "ple_sec", "read_latency_ms", "write_latency_ms", "max_blocking_sessions",
    "avg_active_sessions", "blocker_ratio", "cpu_index", "memory_index", "read_latency_index",
    "write_latency_index", "blocking_index", "irc_index",
]


def score(base: DataFrame, score_thresholds: DataFrame) -> DataFrame:
    """V10 scoring projection: typed passthroughs, five bands (F8), irc_index."""
    th = threshold_scalars(score_thresholds)

    def band(value: str, name: str) -> Column:
        return band_index(value, th[f"{name}_dir"], th[f"{name}_warn"], th[f"{name}_crit"])

    scored = base.select(
        "instance_id", "database_id", "platform", "coll_hr",
        year_s("coll_hr").alias("year"),
        month_t("coll_hr").alias("month"),
        round_half_even_cast("avg_engine_cpu", "smallint").alias("sql_cpu"),
        round_half_even_cast("avg_idle_cpu", "smallint").alias("idl_cpu"),
        round_half_even_cast("avg_other_cpu", "smallint").alias("oth_cpu"),
        round_half_even_cast("avg_ple_sec", "bigint").alias("ple_sec"),
        F.col("read_latency_ms").try_cast("bigint").alias("read_latency_ms"),
        F.col("write_latency_ms").try_cast("bigint").alias("write_latency_ms"),
        F.col("max_blocking_sessions").try_cast("int").alias("max_blocking_sessions"),
        round_half_even_cast("avg_active_sessions", "int").alias("avg_active_sessions"),
        F.col("blocker_ratio").cast("double").alias("blocker_ratio"),
        band("cpu_busy_pct", "cpu").alias("cpu_index"),
        band("avg_ple_sec", "memory").alias("memory_index"),
        band("read_latency_ms", "read_latency").alias("read_latency_index"),
        band("write_latency_ms", "write_latency").alias("write_latency_index"),
        band("blocker_ratio", "blocker").alias("blocking_index"),
    )
    irc = (
        F.col("cpu_index") + F.col("memory_index") + F.col("read_latency_index")
        + F.col("write_latency_index") + F.col("blocking_index")
    ).cast("tinyint")
    return scored.withColumn("irc_index", irc).select(*HEALTH_COLUMNS)


@reuse_plan
def health_scores(lake, as_of) -> DataFrame:
    """One scored row per (instance, eligible database, closed hour)."""
    return score(health_base(lake, as_of), lake.score_thresholds)


@reuse_plan
def health_scores_instance(lake, as_of, scores: DataFrame | None = None) -> DataFrame:
    """V11 (A5): worst database wins, per instance-hour."""
    hs = scores if scores is not None else health_scores(lake, as_of)
    return hs.groupBy("instance_id", "platform", "coll_hr").agg(
        *[F.max(c).alias(c) for c in (
            "cpu_index", "memory_index", "read_latency_index", "write_latency_index",
            "blocking_index", "irc_index",
        )]
    )


# ------------------------------------------------------------ V12 .. V14
def ping_window(pings: DataFrame, as_of) -> DataFrame:
    """Pings strictly newer than ``as_of - 28 days``, none after ``as_of``."""
    lo = minus_days(as_of_col(as_of), PING_ENVELOPE_DAYS)
    pings = pings.filter(F.col("collected_at") <= as_of_col(as_of))
    return time_bound(pings, lo=lo).select("instance_id", "collected_at", "is_success")


def last_success(pings: DataFrame, as_of) -> DataFrame:
    """Newest successful ping per instance inside the envelope."""
    return (
        ping_window(pings, as_of).filter(F.col("is_success"))
        .groupBy("instance_id").agg(F.max("collected_at").alias("last_success_at"))
    )


def recent_failures(pings: DataFrame, as_of) -> DataFrame:
    """J5 + A7: failures in the last 4 days after the last success, at least 3."""
    ls = last_success(pings, as_of)
    lo4 = minus_days(as_of_col(as_of), FAILURE_WINDOW_DAYS)
    fails = ping_window(pings, as_of).filter(~F.col("is_success") & (F.col("collected_at") > lo4))
    # last_success_at is one value per instance, so grouping by it as well
    # carries it to the caller without a second scan and join.
    return (
        fails.join(ls, "instance_id")
        .filter(F.col("collected_at") > F.col("last_success_at"))
        .groupBy("instance_id", "last_success_at").agg(F.count(F.lit(1)).alias("failed_pings"))
        .filter(F.col("failed_pings") >= FAILED_PINGS_MIN)
    )


@reuse_plan
def unresponsive(lake, as_of) -> DataFrame:
    """Instances that stopped answering pings."""
    rf = recent_failures(lake.pings, as_of)
    inst = lake.instances.filter(F.col("status").isin(*ACTIVE_STATUSES)).select("instance_id")
    return rf.join(inst, "instance_id").select(
        "instance_id", F.col("failed_pings").cast("long").alias("failed_pings"), "last_success_at"
    )


IRC_SLOTS = 16  # irc_index is 0..10, so (hour, index) packs into one long


@reuse_plan
def latest_health(lake, as_of, rollup: DataFrame | None = None) -> DataFrame:
    """W1 over V11: the most recent scored hour per instance and its worst index.

    Without a given roll-up this is one aggregation over the scores: the
    worst-database index of the newest hour is the maximum of (hour, index) in
    lexicographic order, packed as ``micros(hour) * 16 + index`` so the
    aggregate keeps fixed-width buffers (hash aggregate, map-side combine).
    """
    if rollup is not None:
        return latest_per_key(rollup.select("instance_id", "coll_hr", "irc_index"), ["instance_id"], ["coll_hr"])
    hs = health_scores(lake, as_of)
    packed = F.unix_micros(F.col("coll_hr").cast("timestamp")) * IRC_SLOTS + F.col("irc_index").cast("long")
    best = hs.groupBy("instance_id").agg(F.max(packed).alias("_p"))
    return best.select(
        "instance_id",
        F.timestamp_micros(F.floor(F.col("_p") / IRC_SLOTS).cast("long")).cast("timestamp_ntz").alias("coll_hr"),
        (F.col("_p") % IRC_SLOTS).cast("tinyint").alias("irc_index"),
    )


@reuse_plan
def high_irc(lake, as_of, rollup: DataFrame | None = None) -> DataFrame:
    """Latest hour's irc_index >= 2."""
    return latest_health(lake, as_of, rollup).filter(F.col("irc_index") >= HIGH_IRC_MIN).select(
        "instance_id", F.col("coll_hr").alias("latest_coll_hr"), "irc_index"
    )


PROBLEM_COLUMNS = [
    "instance_id", "instance_fqn", "platform", "environment", "status", "is_unresponsive",
    "is_high_irc", "failed_pings", "last_success_at", "latest_coll_hr", "irc_index",
]


def worst_first(df: DataFrame) -> DataFrame:
    """O1 (+ instance_id as a deterministic tiebreak)."""
    return df.orderBy(
        F.col("is_unresponsive").desc(), F.col("irc_index").desc(),
        F.col("failed_pings").desc_nulls_last(), F.col("instance_id").asc(),
    )


def assemble_problematic(unresponsive_df: DataFrame, high_irc_df: DataFrame, instances: DataFrame,
                         ordered: bool = True) -> DataFrame:
    """V14 assembly: the two populations (each unique by instance) as one full
    outer join (equal to their UNION followed by two left joins), flagged."""
    u = unresponsive_df.withColumn("_u", F.lit(True))
    h = high_irc_df.withColumn("_h", F.lit(True))
    both = u.join(h, "instance_id", "full")
    inst = instances.select("instance_id", "instance_fqn", "platform", "environment", "status")
    out = both.join(inst, "instance_id").select(
        "instance_id", "instance_fqn", "platform", "environment", "status",
        F.col("_u").isNotNull().alias("is_unresponsive"),
        F.col("_h").isNotNull().alias("is_high_irc"),
        "failed_pings", "last_success_at", "latest_coll_hr",
        F.coalesce(F.col("irc_index"), F.lit(0).cast("tinyint")).alias("irc_index"),
    )
    return worst_first(out) if ordered else out


@reuse_plan
def problematic_instances(lake, as_of, ordered: bool = True) -> DataFrame:
    """Unresponsive OR high-IRC instances, flagged, worst first.

    ``UNION`` of the two key sets followed by two left joins equals one full
    outer join of the two (both are unique by instance_id), which plans the
    scoring subtree once.
    """
    return assemble_problematic(unresponsive(lake, as_of), high_irc(lake, as_of), lake.instances, ordered)


# ------------------------------------------------------- incremental scoring
IO_KEYS = ["instance_id", "database_id"]


def io_latency_seeded(buckets: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """V6 steps 2-4 over new hourly buckets, with the lag seeded from ``state``
    (the last bucket per (instance, database) before them). Returns the latency
    rows of the new buckets and the next state. The window sees one state row
    plus the new hours per key, so its groups stay small.
    """
    cur = buckets.withColumn("_new", F.lit(True))
    both = cur.unionByName(state.withColumn("_new", F.lit(False))) if state is not None else cur
    lagged = lag_with_default(both, IO_KEYS, "coll_hr", IO_NAMES, 0)
    deltas = lagged.filter(F.col("_new") & all_nonzero([f"lag_{c}" for c in IO_NAMES])).select(
        *IO_KEYS, "coll_hr", *[reset_guarded_delta(c, f"lag_{c}").alias(c) for c in IO_NAMES])
    latency = deltas.filter((F.col("num_of_reads") != 0) & (F.col("num_of_writes") != 0)).select(
        *IO_KEYS, "coll_hr",
        floor_ratio("io_wait_read_ms", "num_of_reads").alias("read_latency_ms"),
        floor_ratio("io_wait_write_ms", "num_of_writes").alias("write_latency_ms"),
    )
    next_state = latest_per_key(both.drop("_new"), IO_KEYS, ["coll_hr"])
    return latency, next_state


def score_increment(lake, start, end, io_state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """T13 incremental: scores for the closed hours in ``[start, end)`` (both on
    the hour) and the next IO state.

    Only rows collected in the window are read (folder-pruned on a stored lake);
    the one dependency on earlier data, the previous IO bucket of each
    (instance, database), comes from ``io_state``. Running back-to-back windows
    from the first data onward reproduces the full ``health_scores`` view for
    those hours (eligibility is evaluated at run time).
    """
    lo, hi = as_of_col(start), as_of_col(end)

    def window(df):
        return time_bound(df, lo=lo, hi=hi, lo_strict=False)

    cpu = cpu_hourly(window(lake.metric_cpu))
    buckets = io_bucketed(window(lake.metric_database_io))
    io, next_state = io_latency_seeded(buckets, io_state)
    base = join_health_base(
        eligible_databases(lake.databases, lake.instances), cpu,
        memory_hourly(window(lake.metric_memory)), sessions_hourly(window(lake.metric_sessions)),
        io, blocking_hourly(window(lake.metric_blocking)),
    )
    return score(base, lake.score_thresholds), next_state


RECENT_SCORE_DAYS = 2


def _packed_latest(scores: DataFrame) -> DataFrame:
    packed = F.unix_micros(F.col("coll_hr").cast("timestamp")) * IRC_SLOTS + F.col("irc_index").cast("long")
    best = scores.groupBy("instance_id").agg(F.max(packed).alias("_p"))
    return best.select(
        "instance_id",
        F.timestamp_micros(F.floor(F.col("_p") / IRC_SLOTS).cast("long")).cast("timestamp_ntz").alias("coll_hr"),
        (F.col("_p") % IRC_SLOTS).cast("tinyint").alias("irc_index"),
    )


def latest_health_from_scores(scores: DataFrame, instances: DataFrame, as_of,
                              days: int = RECENT_SCORE_DAYS) -> DataFrame:
    """V13 input from the materialized ``health_scores`` table.

    Recent window first: an instance scored after ``as_of - days`` has its
    latest hour there, and the month folders before that are pruned; only
    instances without a recent score read their older months (semi-join on
    that small set, removed by AQE when empty). Exact.
    """
    lo = minus_days(as_of_col(as_of), days)
    scores = scores.filter(F.col("coll_hr") < closed_hour_cut(as_of))
    recent = scores.filter(F.col("coll_hr") >= lo)
    if {"year", "month"} <= set(scores.columns):
        month = F.make_date(F.col("year").cast("int"), F.col("month").cast("int"), F.lit(1))
        recent = recent.filter(month >= F.trunc(F.to_date(lo), "MM"))
    hit = _packed_latest(recent)
    missing = instances.select("instance_id").join(hit, "instance_id", "left_anti")
    older = _packed_latest(scores.join(missing, "instance_id", "left_semi"))
    return hit.unionByName(older)


def problematic_from_scores(lake, scores: DataFrame, as_of, ordered: bool = True) -> DataFrame:
    """V14 at scale: unresponsive from the 28-day ping window, high IRC from the
    materialized scores instead of recomputing the whole scoring chain."""
    h = latest_health_from_scores(scores, lake.instances, as_of).filter(
        F.col("irc_index") >= HIGH_IRC_MIN).select(
        "instance_id", F.col("coll_hr").alias("latest_coll_hr"), "irc_index")
    return assemble_problematic(unresponsive(lake, as_of), h, lake.instances, ordered)
