"""Registered ingest, source/sink and maintenance jobs. Jobs that write are
checked by reading back what they wrote (a fresh folder under the shared
checkpoint location per call)."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

import fleetpulse.catalog.packs  # noqa: F401  (raw oracle CTEs)
from fleetpulse import schemas as S
from fleetpulse.catalog import register
from fleetpulse.catalog.api import DETAIL_SQL
from fleetpulse.functions.scalar import error_is_conflict
from fleetpulse.operators import joins as J
from fleetpulse.plans import ingest as I
from fleetpulse.plans import scoring as V
from fleetpulse.plans import state
from fleetpulse.plans.state import ScoreStore
from fleetpulse.session import session_key
from fleetpulse.sources import manifest as M
from fleetpulse.sources.derived import AS_OF, DerivedLake
from fleetpulse.sources.raw import RawSnapshots
from fleetpulse.sources.snapshots import SnapshotTable, snapshot
from fleetpulse.streaming import ingest as SI

STAMP_SQL = ("'sqlserver' AS platform, CAST(year(collected_at) AS SMALLINT) AS year, "
             "CAST(month(collected_at) AS TINYINT) AS month, CAST(day(collected_at) AS TINYINT) AS day")


INCREMENT_CUTS = ("2000-01-01 00:00:00", "2024-01-11 00:00:00", "2024-01-21 00:00:00", AS_OF)


def lake(spark, sf_dir) -> DerivedLake:
    return DerivedLake(spark, sf_dir)


def raw(spark, sf_dir) -> RawSnapshots:
    return RawSnapshots(spark, sf_dir)


#: The operational registry of the fixture: many instances share a dial target.
_REGISTRY = """(SELECT instance_id, instance_fqn, instance_name, platform, 'host' || CAST(instance_id % 7 AS VARCHAR) || ',1433' AS connect_target,
  auth_mode, environment, status, registered_at, updated_at FROM instances)"""


_OK_CYCLES = "(SELECT DISTINCT instance_id, date_trunc('day', collected_at) AS collected_at FROM pings WHERE is_success)"
_RESPONSIVE = f"""(SELECT l.* FROM raw_landed_cpu l
   WHERE EXISTS (SELECT 1 FROM {_OK_CYCLES} c WHERE c.instance_id = l.instance_id AND c.collected_at = l.collected_at))"""
_GOOD = """NOT ((engine_cpu_percent IS NOT NULL AND TRY_CAST(engine_cpu_percent AS SMALLINT) IS NULL)
      OR (other_cpu_percent IS NOT NULL AND TRY_CAST(other_cpu_percent AS SMALLINT) IS NULL)
      OR (system_idle_percent IS NOT NULL AND TRY_CAST(system_idle_percent AS SMALLINT) IS NULL))"""
_STAGED = f"""
SELECT instance_id, {STAMP_SQL}, collected_at,
       TRY_CAST(engine_cpu_percent AS SMALLINT) AS engine_cpu_percent,
       TRY_CAST(other_cpu_percent AS SMALLINT) AS other_cpu_percent,
       TRY_CAST(system_idle_percent AS SMALLINT) AS system_idle_percent
FROM {_RESPONSIVE} r WHERE {_GOOD}"""


def _cycle_pings(spark, sf_dir):
    """The fixture's cycles are daily and stamped at midnight, so its pings take that stamp."""
    return lake(spark, sf_dir).pings.withColumn("collected_at", F.date_trunc("day", "collected_at").cast("timestamp_ntz"))


def _landed(spark, sf_dir):
    return raw(spark, sf_dir).raw_landed_cpu.drop("row_id")


@register("stamp_project", _STAGED)
def q_stamp_project(spark, sf_dir):
    """P1 (with P10, P3, P2): landed rows -> target rows in contract order."""
    rows, _ = I.stage(_landed(spark, sf_dir), "metric_cpu", _cycle_pings(spark, sf_dir))
    return rows


@register("typed_coerce", f"""
SELECT instance_id, collected_at, engine_cpu_percent, other_cpu_percent, system_idle_percent
FROM {_RESPONSIVE} r WHERE NOT {_GOOD}""")
def q_typed_coerce(spark, sf_dir):
    """The quarantined rows (a non-NULL value that does not fit its type)."""
    _, bad = I.stage(_landed(spark, sf_dir), "metric_cpu", _cycle_pings(spark, sf_dir))
    return bad.select("instance_id", "collected_at", "engine_cpu_percent", "other_cpu_percent",
                      "system_idle_percent")


@register("partition_stamp", f"""
SELECT DISTINCT instance_id, collected_at, {STAMP_SQL} FROM raw_attempts""")
def q_partition_stamp(spark, sf_dir):
    """One second-resolution stamp per cycle and its year/month/day."""
    a = raw(spark, sf_dir).raw_attempts.select("instance_id", "collected_at")
    return I.cycle_stamp(a).select("instance_id", "collected_at", "platform", "year", "month", "day").distinct()


@register("collector_ingest", _STAGED)
def q_collector_ingest(spark, sf_dir):
    """Stage and append to the partitioned lake, then read the table back."""
    root = I.scratch_path(spark, "lake")
    path, _ = I.collector_ingest(spark, _landed(spark, sf_dir), "metric_cpu", _cycle_pings(spark, sf_dir), root)
    return I.read_lake_table(spark, path, S.METRIC_CPU)


@register("partitioned_append", "SELECT * FROM metric_sessions")
def q_partitioned_append(spark, sf_dir):
    """S3: append the same table in two batches (partitioned, ZSTD); read back whole."""
    path = I.scratch_path(spark, "sessions")
    s = lake(spark, sf_dir).metric_sessions
    I.partitioned_append(s.filter(F.col("day") < 15), path, S.HOT_PARTITIONS)
    I.partitioned_append(s.filter(F.col("day") >= 15), path, S.HOT_PARTITIONS)
    return I.read_lake_table(spark, path, S.METRIC_SESSIONS)


@register("lake_scan", "SELECT * FROM pings WHERE day >= 20 AND instance_id = 1003")
def q_lake_scan(spark, sf_dir):
    """Partition-pruned (day) and pushed-down (instance_id) scan of a written table."""
    path = I.scratch_path(spark, "pings")
    I.partitioned_append(lake(spark, sf_dir).pings, path, S.HOT_PARTITIONS)
    t = I.read_lake_table(spark, path, S.PINGS)
    return t.filter((F.col("day") >= 20) & (F.col("instance_id") == 1003))


@register("ping_facts", f"""
SELECT instance_id, {STAMP_SQL}, collected_at,
       CASE WHEN ok THEN elapsed_ms ELSE 5000 END AS response_time_ms, ok AS is_success
FROM raw_attempts""")
def q_ping_facts(spark, sf_dir):
    """T2."""
    return I.ping_facts(raw(spark, sf_dir).raw_attempts)


@register("error_rows", f"""
SELECT instance_id, connect_target AS instance_fqn, {STAMP_SQL.split(',')[0]}, CAST(NULL AS VARCHAR) AS collector_name,
       collected_at, CAST(year(collected_at) AS SMALLINT) AS year, CAST(month(collected_at) AS TINYINT) AS month,
       CAST(day(collected_at) AS TINYINT) AS day, 'connect' AS error_type,
       'connection failed: timeout expired' AS error_message
FROM raw_attempts WHERE NOT ok
UNION ALL
SELECT r.instance_id, a.connect_target, 'sqlserver', r.collector_name, r.collected_at,
       CAST(year(r.collected_at) AS SMALLINT), CAST(month(r.collected_at) AS TINYINT),
       CAST(day(r.collected_at) AS TINYINT), 'query', min(r.error_message)
FROM raw_results r JOIN raw_attempts a ON a.instance_id = r.instance_id AND a.collected_at = r.collected_at
WHERE a.ok AND r.error_message IS NOT NULL
GROUP BY r.instance_id, a.connect_target, r.collector_name, r.collected_at""")
def q_error_rows(spark, sf_dir):
    """T3."""
    r = raw(spark, sf_dir)
    return I.error_rows(r.raw_attempts, r.raw_results)


_SUMMARY = """
SELECT r.collector_name, r.collected_at, count(DISTINCT r.instance_id) AS instances,
       CAST(sum(r.n_rows) AS INTEGER) AS rows_collected, count(r.error_message) AS errors,
       max(r.duration_ms) AS duration_ms,
       CASE WHEN count(r.error_message) > 0 THEN 'error' WHEN sum(r.n_rows) = 0 THEN 'empty' ELSE 'ok' END AS status
FROM raw_results r
WHERE EXISTS (SELECT 1 FROM raw_attempts a WHERE a.ok AND a.instance_id = r.instance_id
              AND a.collected_at = r.collected_at)
GROUP BY r.collector_name, r.collected_at"""


@register("cycle_summary", _SUMMARY)
def q_cycle_summary(spark, sf_dir):
    """A12."""
    r = raw(spark, sf_dir)
    return I.cycle_summary(r.raw_attempts, r.raw_results)


@register("collection_log", f"""
SELECT CAST(NULL AS INTEGER) AS instance_id, {STAMP_SQL}, collector_name, collected_at, rows_collected,
       duration_ms, status FROM ({_SUMMARY}) s""")
def q_collection_log(spark, sf_dir):
    """T4: write the log rows partitioned and read them back."""
    r = raw(spark, sf_dir)
    path = I.scratch_path(spark, "collection_log")
    I.partitioned_append(I.collection_log(r.raw_attempts, r.raw_results), path, S.HOT_PARTITIONS)
    return I.read_lake_table(spark, path, S.COLLECTION_LOG)


@register("recent_errors", """
SELECT instance_id, collector_name, collected_at, error_type, error_message FROM (
  SELECT instance_id, connect_target AS instance_fqn, CAST(NULL AS VARCHAR) AS collector_name, collected_at,
         'connect' AS error_type, 'connection failed: timeout expired' AS error_message
  FROM raw_attempts WHERE NOT ok
  UNION ALL
  SELECT r.instance_id, a.connect_target, r.collector_name, r.collected_at, 'query', min(r.error_message)
  FROM raw_results r JOIN raw_attempts a ON a.instance_id = r.instance_id AND a.collected_at = r.collected_at
  WHERE a.ok AND r.error_message IS NOT NULL
  GROUP BY r.instance_id, a.connect_target, r.collector_name, r.collected_at) e
ORDER BY collected_at DESC, instance_id, collector_name NULLS FIRST LIMIT 100""")
def q_recent_errors(spark, sf_dir):
    """The newest 100 collection errors (top-k is the feature)."""
    r = raw(spark, sf_dir)
    e = I.error_rows(r.raw_attempts, r.raw_results)
    return e.orderBy(F.col("collected_at").desc(), "instance_id", F.col("collector_name").asc_nulls_first()) \
        .limit(100).select("instance_id", "collector_name", "collected_at", "error_type", "error_message")


@register("error_class", """
SELECT instance_id, collected_at, collector_name, error_message,
       regexp_matches(error_message, '(?i)conflict|serializ|concurrent|out of date|snapshot|transaction|retry')
         AS is_conflict
FROM raw_results WHERE error_message IS NOT NULL""")
def q_error_class(spark, sf_dir):
    """classify error text as a commit conflict by regular expression."""
    r = raw(spark, sf_dir).raw_results.filter(F.col("error_message").isNotNull())
    return r.select("instance_id", "collected_at", "collector_name", "error_message",
                    error_is_conflict("error_message").alias("is_conflict"))


@register("active_fleet", f"""
SELECT instance_id, connect_target, auth_mode, platform FROM {_REGISTRY} r
WHERE status = 'a' AND platform = 'sqlserver' ORDER BY instance_id LIMIT 100000""")
def q_active_fleet(spark, sf_dir):
    """Active instances of one platform, ordered, limited (the limit is the feature)."""
    from fleetpulse.plans.api import active_fleet

    return active_fleet(lake(spark, sf_dir).registry, "sqlserver")


@register("fleet_csv", """SELECT instance_id, connect_target FROM raw_attempts""")
def q_fleet_csv(spark, sf_dir):
    """Write a two-column CSV with a header and read it back with a schema."""
    path = I.scratch_path(spark, "fleet_csv")
    a = raw(spark, sf_dir).raw_attempts.select("instance_id", "connect_target")
    I.write_csv(a, path)
    return I.read_csv(spark, path, "instance_id int, connect_target string")


_TYPED = """
SELECT instance_id, collected_at, TRY_CAST(engine_cpu_percent AS SMALLINT) AS engine_cpu_percent,
       TRY_CAST(other_cpu_percent AS SMALLINT) AS other_cpu_percent,
       TRY_CAST(system_idle_percent AS SMALLINT) AS system_idle_percent,
       (engine_cpu_percent IS NOT NULL AND TRY_CAST(engine_cpu_percent AS SMALLINT) IS NULL)
       OR (other_cpu_percent IS NOT NULL AND TRY_CAST(other_cpu_percent AS SMALLINT) IS NULL) AS rejected"""


def _land_json(df, path: str) -> str:
    """Result rows as a collector lands them: JSON numbers, and text where the server gave none."""
    def value(c: str):
        number = F.col(c).try_cast("int")
        return F.when(F.col(c).isNull(), F.lit("null")).when(number.isNotNull(), number.cast("string")) \
            .otherwise(F.concat(F.lit('"'), F.col(c), F.lit('"')))

    names = [c for c, _ in M.query_columns("metric_cpu")]
    parts = [F.concat(F.lit(f', "{c}": '), value(c)) for c in names]
    at = F.date_format("collected_at", "yyyy-MM-dd'T'HH:mm:ss")
    line = F.concat(F.lit('{"instance_id": '), F.col("instance_id").cast("string"), F.lit(', "collected_at": "'), at, F.lit('"'),
                    *parts, F.lit("}"))
    df.select(line.alias("value")).write.mode("errorifexists").text(path)
    return path


@register("raw_stage", _TYPED + " FROM raw_landed_cpu")
def q_raw_stage(spark, sf_dir):
    """Landed JSON result rows read with the contract's types; a record that does not fit is marked, with its text."""
    path = _land_json(_landed(spark, sf_dir), I.scratch_path(spark, "landed"))
    return SI.read_landed(spark, path, "metric_cpu").select(
        "instance_id", "collected_at", *[c for c, _ in M.query_columns("metric_cpu")],
        F.col(SI.REJECTED).isNotNull().alias("rejected"))


#: The stream's landed rows: every CPU sample of the fleet at its own 5-minute cycle.
_CYCLE = "time_bucket(INTERVAL 5 MINUTE, ts)"
_LANDED_5M = f"""(SELECT r.instance_id, {_CYCLE} AS collected_at, r.engine_cpu_percent, r.other_cpu_percent, r.system_idle_percent
  FROM raw_landed_cpu r JOIN events e ON e.event_id = r.row_id)"""
_OK_5M = "(SELECT DISTINCT instance_id, time_bucket(INTERVAL 5 MINUTE, collected_at) AS collected_at FROM pings WHERE is_success)"
_RESPONSIVE_5M = f"""(SELECT l.* FROM {_LANDED_5M} l
   WHERE EXISTS (SELECT 1 FROM {_OK_5M} c WHERE c.instance_id = l.instance_id AND c.collected_at = l.collected_at))"""
_TYPED_5M = f"({_TYPED} FROM {_RESPONSIVE_5M} r)"


def _cycle_of(ts):
    return F.window(ts, "5 minutes")["start"].cast("timestamp_ntz")


_STREAMS: dict = {}


def _ingested(spark, sf_dir) -> SI.CollectorSink:
    """Landed 5-minute cycles streamed to the end, then its first batch replayed; built once per session and folder."""
    key = (session_key(spark), sf_dir)
    if key not in _STREAMS:
        lk, root = lake(spark, sf_dir), I.scratch_path(spark, "ingest_stream")
        cycles = lk.ev.select(F.col("event_id").alias("row_id"), _cycle_of("ts").alias("collected_at"))
        landed = raw(spark, sf_dir).raw_landed_cpu.drop("collected_at").join(cycles, "row_id").drop("row_id")
        path = _land_json(landed, f"{root}/landed")
        pings = lk.pings.withColumn("collected_at", _cycle_of("collected_at"))
        sink = SI.CollectorSink(spark, "metric_cpu", f"{root}/metric_cpu", lambda: pings, lk.registry)
        source = SI.read_landed_stream(spark, path, "metric_cpu", files_per_trigger=4)
        SI.ingest_stream(spark, source, sink, f"{root}/metric_cpu")
        sink(SI.read_landed(spark, path, "metric_cpu"), 0)  # a replayed batch adds nothing
        _STREAMS[key] = sink
    return _STREAMS[key]


@register("collector_ingest_stream", f"""
SELECT instance_id, {STAMP_SQL}, collected_at, engine_cpu_percent, other_cpu_percent, system_idle_percent
FROM {_TYPED_5M} t WHERE NOT rejected""")
def q_collector_ingest_stream(spark, sf_dir):
    """T1 as a stream: typed rows of responsive 5-minute cycles, each batch committed once."""
    return _ingested(spark, sf_dir).rows()


@register("rejected_error_rows", f"""
SELECT t.instance_id, i.connect_target AS instance_fqn, {STAMP_SQL}, 'metric_cpu' AS collector_name, t.collected_at,
       'query' AS error_type
FROM {_TYPED_5M} t LEFT JOIN {_REGISTRY} i ON i.instance_id = t.instance_id WHERE rejected""")
def q_rejected_error_rows(spark, sf_dir):
    """T3 for the stream: every rejected record as an error row (its message quotes the record)."""
    return _ingested(spark, sf_dir).errors().drop("error_message")


@register("quarantined_records", f"SELECT instance_id, collected_at, 'metric_cpu' AS collector_name FROM {_TYPED_5M} t WHERE rejected")
def q_quarantined_records(spark, sf_dir):
    """The stored quarantine of the stream, a row per rejected record (whose text it keeps)."""
    return _ingested(spark, sf_dir).quarantine().drop(SI.REJECTED)


@register("file_stats")
def q_file_stats(spark, sf_dir):
    """Object count and total bytes under a written table (no SQL oracle: sizes depend on the writer)."""
    path = I.scratch_path(spark, "pings_stats")
    I.partitioned_append(lake(spark, sf_dir).pings, path, S.HOT_PARTITIONS)
    return I.file_stats(spark, path)


@register("file_counts", "SELECT count(DISTINCT day) AS objects, count(DISTINCT day) AS folders, true AS sizes_agree, count(*) AS n_rows FROM pings")
def q_file_counts(spark, sf_dir):
    """S10 with what SQL can tell: a batch leaves one file per folder, and the sizes that the rows' files report are those
    of the listing."""
    path = I.scratch_path(spark, "pings_counts")
    I.partitioned_append(lake(spark, sf_dir).pings, path, S.HOT_PARTITIONS)
    listed = snapshot(spark, path).agg(F.countDistinct("folder").alias("folders"), F.sum("length").alias("bytes"))
    rows = I.read_lake_table(spark, path, S.PINGS).agg(F.count(F.lit(1)).alias("n_rows"))
    one = F.lit(1).alias("_one")
    both = I.file_stats(spark, path).select("*", one).join(listed.select("*", one), "_one").join(rows.select("*", one), "_one")
    return both.select("objects", "folders", (F.col("total_bytes") == F.col("bytes")).alias("sizes_agree"), "n_rows")


@register("series_rows", f"""
SELECT l AS instance_fqn, l AS instance_name, 'localhost' AS connect_target, 'sqlserver' AS platform, 'integrated' AS auth_mode,
       'P' AS environment, 'a' AS status
FROM (SELECT 'supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS l FROM customer) g
WHERE l NOT IN (SELECT instance_fqn FROM instances)""")
def q_series_rows(spark, sf_dir):
    """A generated series of labels, inserted only if absent; the first of them are the fleet's own."""
    lk = lake(spark, sf_dir)
    label = F.concat(F.lit("supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    series = lk.base("customer").select(label.alias("instance_fqn"), F.lit("localhost").alias("connect_target"))
    return I.new_labels(lk.registry, series)


_REG_SRC = """(SELECT CAST(1000 + s_suppkey AS INTEGER) AS instance_id, upper(s_name) AS instance_fqn,
        'sqlserver' AS platform, 'integrated' AS auth_mode, TIMESTAMP '2024-01-15 00:00:00' AS registered_at
 FROM supplier WHERE s_suppkey % 2 = 1)"""


@register("sync_dimension", f"""
SELECT instance_id, instance_fqn, status FROM instances WHERE instance_id NOT IN (SELECT instance_id FROM {_REG_SRC})
UNION ALL SELECT instance_id, instance_fqn, CAST(NULL AS VARCHAR) FROM {_REG_SRC}""")
def q_sync_dimension(spark, sf_dir):
    """Replace-by-key sync of the instance dimension, then overwrite the small table."""
    lk = lake(spark, sf_dir)
    path = I.scratch_path(spark, "instances")
    lk.instances.write.mode("overwrite").parquet(path)
    src = lk.base("supplier").filter(F.col("s_suppkey") % 2 == 1).select(
        (F.lit(1000) + F.col("s_suppkey")).cast("int").alias("instance_id"),
        F.upper("s_name").alias("instance_fqn"), F.lit("sqlserver").alias("platform"),
        F.lit("integrated").alias("auth_mode"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz").alias("registered_at"))
    out = I.sync_dimension(spark, path, src, I.scratch_path(spark, "instances_v2"))
    return spark.read.schema(S.INSTANCES).parquet(out).select("instance_id", "instance_fqn", "status")


@register("get_or_create_ids", f"""
WITH lab AS (
  SELECT lower(c_name) AS instance_fqn, 'tcp:' || lower(c_name) AS connect_target,
         CASE WHEN c_custkey % 3 = 0 THEN 'Q' END AS environment, CASE WHEN c_custkey % 5 = 0 THEN 'sql' END AS auth_mode,
         CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) END AS instance_name FROM customer
  UNION SELECT instance_fqn, 'tcp:' || instance_fqn, 'Q', 'sql', 'renamed' FROM instances WHERE instance_id % 2 = 0),
new AS (SELECT (SELECT max(instance_id) FROM {_REGISTRY} r) + row_number() OVER (ORDER BY instance_fqn) AS instance_id, lab.*
        FROM lab WHERE instance_fqn NOT IN (SELECT instance_fqn FROM instances))
SELECT r.instance_id, r.instance_fqn, r.instance_name, r.platform, coalesce(l.connect_target, r.connect_target) AS connect_target,
       r.auth_mode, r.environment, r.status, r.registered_at,
       CASE WHEN l.instance_fqn IS NULL THEN r.updated_at ELSE TIMESTAMP '{AS_OF}' END AS updated_at
FROM {_REGISTRY} r LEFT JOIN lab l USING (instance_fqn)
UNION ALL
SELECT CAST(instance_id AS INTEGER), instance_fqn, coalesce(instance_name, instance_fqn), 'sqlserver', connect_target,
       coalesce(auth_mode, 'integrated'), coalesce(environment, 'P'), 'a', TIMESTAMP '{AS_OF}', CAST(NULL AS TIMESTAMP) FROM new""")
def q_get_or_create_ids(spark, sf_dir):
    """Labels that exist keep all but their target and time; new ones get max+1.. and defaults for what is not
    given."""
    lk = lake(spark, sf_dir)
    c = F.col("c_custkey")
    cust = lk.base("customer").select(
        F.lower("c_name").alias("instance_fqn"), F.when(c % 3 == 0, "Q").alias("environment"),
        F.when(c % 5 == 0, "sql").alias("auth_mode"), F.when(c % 2 == 0, F.upper("c_name")).alias("instance_name"))
    mine = lk.instances.filter(F.col("instance_id") % 2 == 0).select(
        "instance_fqn", F.lit("Q").alias("environment"), F.lit("sql").alias("auth_mode"), F.lit("renamed").alias("instance_name"))
    labels = cust.unionByName(mine).withColumn("connect_target", F.concat(F.lit("tcp:"), F.col("instance_fqn")))
    registry = I.Registry(spark, I.scratch_path(spark, "registry"))
    registry.ledger.commit("seed", {"registry": registry.ledger.write("registry", lk.registry)})
    registry.get_or_create(labels, AS_OF)
    return registry.read()


@register("compact_partitions", "SELECT * FROM pings")
def q_compact_partitions(spark, sf_dir):
    """Many small appends packed into larger files, folder by folder; rows unchanged."""
    path = I.scratch_path(spark, "pings_small")
    p = lake(spark, sf_dir).pings
    for k in range(4):
        I.partitioned_append(p.filter(F.col("instance_id") % 4 == k), path, S.HOT_PARTITIONS)
    table = SnapshotTable(spark, I.scratch_path(spark, "pings_list"), S.PINGS, S.HOT_PARTITIONS)
    table.adopt(path)
    table.compact()
    return table.read()


@register("retention", "SELECT * FROM pings WHERE collected_at >= TIMESTAMP '2024-01-10 12:00:00'")
def q_retention(spark, sf_dir):
    """Expire rows older than a cutoff: folders leave the list, the cutoff's own day is rewritten."""
    path = I.scratch_path(spark, "pings_ret")
    I.partitioned_append(lake(spark, sf_dir).pings, path, S.HOT_PARTITIONS)
    table = SnapshotTable(spark, I.scratch_path(spark, "pings_kept"), S.PINGS, S.HOT_PARTITIONS)
    table.adopt(path)
    table.retain("2024-01-10 12:00:00")
    return table.read()


@register("materialize_scores", "SELECT * FROM o_health_scores")
def q_materialize_scores(spark, sf_dir):
    """All closed hours scored in one run; the run repeated replaces its hours."""
    store = ScoreStore(spark, I.scratch_path(spark, "scores"))
    for _ in range(2):
        store.run(lake(spark, sf_dir), INCREMENT_CUTS[0], AS_OF)
    return store.scores()


@register("problematic_from_lake", "SELECT * FROM o_problematic")
def q_problematic_from_lake(spark, sf_dir):
    """S1 + S3 + V14: the flagship over a stored, partitioned lake (folders pruned by the
    year/month/day predicates that accompany every time bound)."""
    from fleetpulse.sources.lake import materialize

    stored = materialize(lake(spark, sf_dir), I.scratch_path(spark, "lake"))
    return V.problematic_instances(stored, AS_OF)


_MANIFEST_SQL = "(VALUES " + ", ".join(
    f"('{n}', '{cad}')" for n, _t, _l, cad, _to, en, _c in M.COLLECTORS if en is not False
) + ") m(collector_name, cadence)"


@register("cycle_summary_run", f"""
WITH run AS (SELECT max(collected_at) AS run_at FROM raw_attempts),
s AS ({_SUMMARY})
SELECT m.collector_name, coalesce(s.collected_at, (SELECT run_at FROM run)) AS collected_at,
       CAST(coalesce(s.instances, 0) AS BIGINT) AS instances, CAST(coalesce(s.rows_collected, 0) AS INTEGER) AS rows_collected,
       CAST(coalesce(s.errors, 0) AS BIGINT) AS errors, s.duration_ms, coalesce(s.status, 'empty') AS status
FROM {_MANIFEST_SQL}
LEFT JOIN s ON s.collector_name = m.collector_name AND s.collected_at = (SELECT run_at FROM run)""")
def q_cycle_summary_run(spark, sf_dir):
    """A12 one-run form: the newest cycle, every manifest collector listed."""
    r = raw(spark, sf_dir)
    return I.cycle_summary_for(spark, r.raw_attempts, r.raw_results)


@register("cadence_tiers", f"""
SELECT m.cadence, count(DISTINCT s.collector_name) AS collectors, sum(s.rows_collected) AS rows_collected,
       sum(s.errors) AS errors
FROM ({_SUMMARY}) s JOIN {_MANIFEST_SQL} ON m.collector_name = s.collector_name
GROUP BY m.cadence""")
def q_cadence_tiers(spark, sf_dir):
    """One tier per cadence over enabled collectors, applied to the cycles' results."""
    r = raw(spark, sf_dir)
    return I.cadence_tiers(spark, r.raw_attempts, r.raw_results)


@register("cadence_tier_streams", f"""
SELECT m.cadence, r.collector_name, r.collected_at, CAST(sum(r.n_rows) AS BIGINT) AS rows_collected, count(r.error_message) AS errors
FROM raw_results r JOIN {_MANIFEST_SQL} ON m.collector_name = r.collector_name
GROUP BY m.cadence, r.collector_name, r.collected_at""")
def q_cadence_tier_streams(spark, sf_dir):
    """T5: one stream and checkpoint per cadence tier over one source of results, each run to its end."""
    root = I.scratch_path(spark, "tiers")
    results = raw(spark, sf_dir).raw_results
    results.write.parquet(f"{root}/results")
    ledgers = SI.run_tiers(spark, lambda: spark.readStream.schema(results.schema).parquet(f"{root}/results"), root)
    done = functools.reduce(lambda a, b: a.unionByName(b), (ledger.read("done", SI.TIER_DONE) for ledger in ledgers.values()))
    return done.groupBy("cadence", "collector_name", "collected_at").agg(
        F.sum("rows_collected").alias("rows_collected"), F.sum("errors").alias("errors"))


@register("problematic_from_scores", "SELECT * FROM o_problematic")
def q_problematic_from_scores(spark, sf_dir):
    """T13 + V14: scores materialized once (partitioned by month), then the flagship
    reads them recent-window first instead of recomputing the scoring chain."""
    path = I.scratch_path(spark, "health_scores")
    lk = lake(spark, sf_dir)
    I.overwrite_partitions(V.health_scores(lk, AS_OF), path, S.SCORE_PARTITIONS)
    scores = I.read_lake_table(spark, path, S.HEALTH_SCORES)
    return V.problematic_from_scores(lk, scores, AS_OF)


_STORES: dict = {}


def _store(spark, sf_dir) -> ScoreStore:
    """Three runs over the stored lake, the middle one repeated; built once per session and folder.

    The lake is derived and stored once, so a run reads the folders of its window and no run derives history again.
    """
    from fleetpulse.sources.lake import materialize

    key = (session_key(spark), sf_dir)
    if key not in _STORES:
        stored = materialize(lake(spark, sf_dir), I.scratch_path(spark, "store_lake"), state.READS)
        store = ScoreStore(spark, I.scratch_path(spark, "score_store"))
        for start, end in (*zip(INCREMENT_CUTS, INCREMENT_CUTS[1:]), INCREMENT_CUTS[1:3]):
            store.run(stored, start, end)
        store.remove_dead()
        _STORES[key] = store
    return _STORES[key]


@register("materialize_scores_incremental", "SELECT * FROM o_health_scores")
def q_materialize_scores_incremental(spark, sf_dir):
    """T13 incremental: three runs, each scoring only its new closed hours with the IO lag
    seeded from the previous run's state, one of them twice; together they equal the full view."""
    return _store(spark, sf_dir).scores()


@register("high_irc_from_state", "SELECT * FROM o_high_irc")
def q_high_irc_from_state(spark, sf_dir):
    """V13 from the maintained state: no history is scanned."""
    return state.high_irc(_store(spark, sf_dir), lake(spark, sf_dir).instances)


@register("problematic_from_state", "SELECT * FROM o_problematic")
def q_problematic_from_state(spark, sf_dir):
    """V14 from the maintained state and the 28-day ping window."""
    return state.problematic_instances(_store(spark, sf_dir), lake(spark, sf_dir), AS_OF)


@register("instance_detail_from_state", DETAIL_SQL)
def q_instance_detail_from_state(spark, sf_dir):
    """Q3 / O3 from the maintained state, one row per instance."""
    return state.instance_detail(_store(spark, sf_dir), lake(spark, sf_dir).instances)
