"""Rerunnable writes: ledger, score store, streamed ingest, key filter, compaction, retention, registry, tiers."""

import datetime as dt
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from fleetpulse import schemas as S
from fleetpulse.operators import joins as J
from fleetpulse.plans import ingest as I
from fleetpulse.plans import scoring as V
from fleetpulse.plans import state
from fleetpulse.sources import manifest as M
from fleetpulse.sources import snapshots as SN
from fleetpulse.sources.derived import AS_OF, DerivedLake
from fleetpulse.sources.ledger import Conflict, Ledger
from fleetpulse.streaming import ingest as SI

SF = "/root/testdata/sf0.001"


def same(a, b):
    a, b = a.select(sorted(a.columns)), b.select(sorted(b.columns))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


# ------------------------------------------------------------------ ledger
def test_newest_run_of_every_range_is_read(spark, scratch):
    ledger = Ledger(spark, scratch)
    schema = "t timestamp_ntz, v int"

    def run(name, low, high, v, commit=True):
        hours = [(dt.datetime(2024, 1, 1, h), v) for h in range(low, high)]
        folder = ledger.write("rows", spark.createDataFrame(hours, schema))
        if commit:
            ledger.commit(name, {"rows": folder}, f"2024-01-01 {low:02d}:00:00", f"2024-01-01 {high:02d}:00:00")

    assert ledger.records() == [] and ledger.newest() is None
    run("a", 0, 6, 1)
    run("b", 6, 12, 2)
    run("lost", 0, 24, 9, commit=False)
    run("c", 4, 8, 3)
    run("b", 6, 12, 4)
    run("d", 5, 5 + 1, 5)
    typed = spark.createDataFrame([], schema).schema
    got = {r.t.hour: r.v for r in ledger.read("rows", typed, "t").collect()}
    assert got == {**{h: 1 for h in range(4)}, 4: 3, 5: 5, **{h: 4 for h in range(6, 12)}}
    assert ledger.read("rows", typed, "t").count() == 12
    assert ledger.remove_dead() == 2  # the lost run and the replaced one of b
    assert ledger.read("rows", typed, "t").count() == 12
    with pytest.raises(Conflict):
        ledger.commit("late", {}, after=2)
    ledger.commit("next", {}, after=4)
    assert [r.seq for r in ledger.records()] == list(range(6)) and ledger.has("next")
    assert ledger.read("none", typed).count() == 0


# ------------------------------------------------------- T13, V13, V14, Q3
@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    lk = DerivedLake(spark, SF)
    out = state.ScoreStore(spark, str(tmp_path_factory.mktemp("store")))
    cuts = ("2000-01-01 00:00:00", "2024-01-20 00:00:00", "2024-01-21 00:00:00", AS_OF)
    for start, end in zip(cuts, cuts[1:]):
        out.run(lk, start, end)
    return lk, out


def test_increments_and_reruns_equal_the_full_view(spark, store):
    lk, out = store
    full = V.health_scores(lk, AS_OF)
    assert same(out.scores(), full)  # two runs within one month leave each other's days alone
    before = out.by_instance().collect(), out.by_database().count()
    out.run(lk, "2024-01-20 00:00:00", "2024-01-21 00:00:00")
    assert same(out.scores(), full)
    assert sorted(map(str, out.by_instance().collect())) == sorted(map(str, before[0]))
    assert out.by_database().count() == before[1]
    assert out.remove_dead() > 0 and same(out.scores(), full)
    with pytest.raises(ValueError):
        out.run(lk, "2024-02-10 00:00:00", "2024-02-11 00:00:00")


def test_latest_state_equals_history(spark, store):
    lk, out = store
    assert same(state.high_irc(out, lk.instances), V.high_irc(lk, AS_OF))
    assert same(state.problematic_instances(out, lk, AS_OF, ordered=False), V.problematic_instances(lk, AS_OF, ordered=False))
    from fleetpulse.plans.api import instance_detail

    assert same(state.instance_detail(out, lk.instances), instance_detail(lk))
    # no reader of the state scans a history table
    for df in (state.high_irc(out, lk.instances), state.instance_detail(out, lk.instances)):
        scans = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]
        assert scans and not [x for x in scans if "events.parquet" in x or "/scores/" in x]


def test_empty_store(spark, scratch):
    lk, out = DerivedLake(spark, SF), state.ScoreStore(spark, scratch)
    assert out.scores().count() == 0 and state.high_irc(out, lk.instances).count() == 0
    assert state.instance_detail(out, lk.instances).count() == lk.instances.count()


def test_registered_store_derives_the_lake_once(spark, monkeypatch):
    from fleetpulse.catalog import ingest

    plans, run = [], state.ScoreStore.run

    def spy(self, lake, start, end):
        plans.append({t: getattr(lake, t)._jdf.queryExecution().executedPlan().toString() for t in state.READS})
        run(self, lake, start, end)

    monkeypatch.setattr(ingest, "_STORES", {})
    monkeypatch.setattr(state.ScoreStore, "run", spy)
    store = ingest._store(spark, SF)
    assert len(plans) == 4  # three runs, one of them twice
    for plan in plans:  # a scan of stored rows, nothing derived from the inputs again
        assert not [t for t, p in plan.items() if re.search(r"events\.parquet|supplier\.parquet|Window|Exchange|Aggregate|Join", p)]
    assert same(store.scores(), V.health_scores(DerivedLake(spark, SF), AS_OF))


def test_newest_scored_hashes_its_rows(spark):
    rows = [(1, 5, dt.datetime(2024, 1, 2, h), i) for h, i in ((3, 9), (4, 2), (4, 10), (1, 0))]
    rows += [(1, None, dt.datetime(1969, 12, 31, 22), 10), (1, None, dt.datetime(1969, 12, 31, 23), 1)]
    scores = spark.createDataFrame(rows, "instance_id int, database_id int, coll_hr timestamp_ntz, irc_index tinyint")
    out = state.newest_scored(scores, 7)
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.schema["scored"].dataType.simpleString() == state.SCORED.simpleString()
    got = {(r.instance_id, r.database_id): tuple(r.scored) for r in out.collect()}
    assert got[1, 5] == (dt.datetime(2024, 1, 2, 4), 7, 10)
    assert got[1, None] == (dt.datetime(1969, 12, 31, 23), 7, 1)


# ------------------------------------------------------------ T1, S8, T3
def land(path, name, rows):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as fh:
        fh.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def sample(instance, minute, engine, **more):
    return {"instance_id": instance, "collected_at": f"2024-01-02T10:{minute:02d}:00", "engine_cpu_percent": engine,
            "other_cpu_percent": 1, "system_idle_percent": 2, **more}


def test_streamed_ingest_commits_once(spark, scratch):
    landed, root = os.path.join(scratch, "landed"), os.path.join(scratch, "cpu")
    at = lambda m: dt.datetime(2024, 1, 2, 10, m, 0, 250_000)
    pings = spark.createDataFrame([(1, at(0), True), (1, at(5), True), (2, at(0), False), (3, at(5), True)],
                                  "instance_id int, collected_at timestamp_ntz, is_success boolean")
    targets = spark.createDataFrame([(1, "host1,1433"), (2, "host2")], "instance_id int, connect_target string")
    sink = SI.CollectorSink(spark, "metric_cpu", root, lambda: pings, targets)
    land(landed, "a.json", [sample(1, 0, 7), sample(2, 0, 8), sample(1, 0, 40000), sample(1, 0, None), "no json at all"])

    def go():
        SI.ingest_stream(spark, SI.read_landed_stream(spark, landed, "metric_cpu", 1), sink, root)

    def seen():
        return sink.rows().count(), sink.quarantine().count(), sink.errors().count()

    go()
    assert seen() == (2, 2, 1)
    err = sink.errors().first()
    assert (err.instance_id, err.instance_fqn, err.collector_name, err.error_type) == (1, "host1,1433", "metric_cpu", "query")
    assert "40000" in err.error_message and err.collected_at == dt.datetime(2024, 1, 2, 10, 0)
    whole = sorted(r.rejected_record for r in sink.quarantine().collect())
    assert whole[0] == "no json at all" and json.loads(whole[1])["engine_cpu_percent"] == 40000
    land(landed, "b.json", [sample(1, 5, 9), sample(3, 5, "x")])
    go()
    assert seen() == (3, 3, 2)
    assert sink.errors().filter("instance_id = 3").first().instance_fqn is None
    # a replay, with the stream's memory of the batch gone but the commit there, adds nothing
    sink(SI.read_landed(spark, landed, "metric_cpu"), 1)
    # a batch that was lost before its commit left folders that nobody reads
    sink.ledger.write("rows", sink.rows(), sink.partitions)
    assert seen() == (3, 3, 2)
    assert sink.rows().schema.simpleString() == S.METRIC_CPU.simpleString()
    again = SI.CollectorSink(spark, "metric_cpu", root, lambda: pings, targets)
    SI.ingest_stream(spark, SI.read_landed_stream(spark, landed, "metric_cpu"), again, root)
    assert again.rows().count() == 3


def test_quarantine_of_a_rerun_is_not_doubled(spark, scratch):
    at = dt.datetime(2024, 1, 2, 10, 5)
    pings = spark.createDataFrame([(1, at, True)], "instance_id int, collected_at timestamp_ntz, is_success boolean")
    landed = spark.createDataFrame(
        [(1, at, "x", "1", "2")],
        "instance_id int, collected_at timestamp_ntz, engine_cpu_percent string, other_cpu_percent string, system_idle_percent string")
    for _ in range(2):
        _, bad = I.collector_ingest(spark, landed, "metric_cpu", pings, scratch, run="r1")
    assert bad.count() == 1


def test_tiers_run_on_their_own_checkpoints(spark, scratch):
    src = os.path.join(scratch, "results")
    rows = [(i, dt.datetime(2024, 1, 2, 10, 0), c, 2, None) for i in (1, 2) for c in M.COLLECTOR_NAMES]
    schema = "instance_id int, collected_at timestamp_ntz, collector_name string, n_rows int, error_message string"
    spark.createDataFrame(rows, schema).write.parquet(src)

    def results():
        return spark.readStream.schema(schema).parquet(src)

    for _ in range(2):  # the second call finds nothing new
        ledgers = SI.run_tiers(spark, results, os.path.join(scratch, "tiers"))
        done = [r for led in ledgers.values() for r in led.read("done", SI.TIER_DONE).collect()]
        assert sorted(r.collector_name for r in done) == sorted(M.COLLECTOR_NAMES)
        assert {r.cadence for r in done} == {"5m", "15m", "hourly"} and all(r.rows_collected == 4 for r in done)


# ------------------------------------------------------------------- J8
def test_key_filter_reaches_the_scan(spark, scratch):
    lk, path = DerivedLake(spark, SF), os.path.join(scratch, "pings")
    I.partitioned_append(lk.pings.filter("day < 25"), path, S.HOT_PARTITIONS)
    target = I.read_lake_table(spark, path, S.PINGS)
    batch = lk.pings.filter("day in (24, 25) and instance_id % 4 = 0")
    keys = ["instance_id", "collected_at"]
    new = J.insert_if_absent(batch, target, keys, S.HOT_PARTITIONS)
    assert sorted(new.select(batch.columns).collect()) == sorted(batch.dropDuplicates(keys).filter("day = 25").collect())
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert any("PartitionFilters: [array_contains(Subquery" in x for x in plan.splitlines())
    near = J.in_folders(target, batch, S.HOT_PARTITIONS)
    assert {r.day for r in near.select("day").distinct().collect()} == {24}
    read = near.select(F.input_file_name()).distinct().collect()
    assert all("day=24" in r[0] for r in read)
    passed = J.may_contain(near, batch, keys)
    hits = near.join(batch.select(*keys).distinct(), keys, "left_semi").count()
    assert hits <= passed.count() <= hits + 2 < near.count()
    crowded = J.may_contain(near, batch, keys, bits=64)  # a full filter lets all pass, and loses none
    assert hits <= crowded.count() <= near.count()
    assert J.insert_if_absent(new, new, keys).count() == 0


# ------------------------------------------------------------- T11, T12
def test_bins_fill_up():
    assert SN.bins([], 10) == []
    got = SN.bins([("a", 6), ("b", 5), ("c", 4), ("d", 4), ("e", 1), ("f", 12)], 10)
    assert sorted(x for b in got for x in b) == list("abcdef")
    assert sorted(map(sorted, got)) == [["a", "c"], ["b", "d", "e"], ["f"]]


def paths(table):
    return {r.path: r.length for r in table.files().collect()}


def test_compaction_leaves_large_files(spark, scratch):
    lk, path = DerivedLake(spark, SF), os.path.join(scratch, "pings")
    p = lk.pings.filter("day <= 3")
    I.partitioned_append(p.coalesce(1), path, S.HOT_PARTITIONS)
    for k in range(6):
        I.partitioned_append(p.filter(f"instance_id < 1020 and instance_id % 6 = {k}"), path, S.HOT_PARTITIONS)
    table = SN.SnapshotTable(spark, os.path.join(scratch, "list"), S.PINGS, S.HOT_PARTITIONS)
    table.adopt(path)
    rows, before = table.read().collect(), paths(table)
    target = 2 * sorted(before.values())[-3]  # the three whole-day files are at least half of it
    large = {f for f, n in before.items() if n >= target // 2}
    table.compact(target)
    after = paths(table)
    assert large and large <= set(after) and len(after) < len(before)
    assert len(after) - len(large) <= (len(before) - len(large)) // 2
    assert sorted(table.read().collect()) == sorted(rows)
    assert table.remove_unlisted() == len(set(before) - set(after))
    assert sorted(table.read().collect()) == sorted(rows)
    again = paths(table)
    table.compact(1)  # nothing is small
    assert paths(table) == again


def test_retention_touches_one_folder(spark, scratch):
    lk, path = DerivedLake(spark, SF), os.path.join(scratch, "pings")
    I.partitioned_append(lk.pings, path, S.HOT_PARTITIONS)
    table = SN.SnapshotTable(spark, os.path.join(scratch, "list"), S.PINGS, S.HOT_PARTITIONS)
    table.adopt(path)
    before = paths(table)
    table.retain("2024-01-10 12:00:00")
    after = paths(table)
    assert same(table.read(), lk.pings.filter("collected_at >= timestamp_ntz'2024-01-10 12:00:00'"))
    assert {f for f in after if f in before} == {f for f in before if int(f.split("/day=")[1].split("/")[0]) > 10}
    assert all("/day=10/" in f for f in set(after) - set(before))
    table.retain("2024-01-15 00:00:00")  # on the day's edge nothing is written
    assert set(paths(table)) == {f for f in after if int(f.split("/day=")[1].split("/")[0]) >= 15}
    table.retain("2025-01-01 06:00:00")
    assert table.read().count() == 0


# ------------------------------------------------------------------ T10
def test_registry_under_concurrent_runs(spark, scratch, monkeypatch):
    registry = I.Registry(spark, scratch)
    labels = lambda *rows: spark.createDataFrame(rows, "instance_fqn string, connect_target string, environment string")
    registry.get_or_create(labels(("b", "t1", None), ("a", "t1", "Q"), ("a", "t0", "Q"), (None, "x", None)), "2024-01-01 00:00:00")
    first = {r.instance_fqn: r.instance_id for r in registry.read().collect()}
    assert first == {"a": 1000, "b": 1001}
    # another run commits between this run's read and its commit
    write, other = registry.ledger.write, I.Registry(spark, scratch)
    monkeypatch.setattr(registry.ledger, "write", lambda *a: (monkeypatch.undo(), other.get_or_create(labels(("c", "t3", None)), "2024-01-02 00:00:00"), write(*a))[2])
    registry.get_or_create(labels(("d", "t4", None), ("a", "t5", "P")), "2024-01-03 00:00:00")
    got = {r.instance_fqn: r for r in registry.read().collect()}
    assert {k: r.instance_id for k, r in got.items()} == {"a": 1000, "b": 1001, "c": 1002, "d": 1003}
    a, d = got["a"], got["d"]
    assert (a.connect_target, a.environment, a.updated_at, a.registered_at) == ("t5", "Q", dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 1))
    assert (d.instance_name, d.platform, d.auth_mode, d.environment, d.status, d.updated_at) == ("d", "sqlserver", "integrated", "P", "a", None)
    assert got["b"].updated_at is None


def test_new_labels_meet_existing_ones(spark):
    lk = DerivedLake(spark, SF)
    have = lk.registry.select("instance_fqn")
    series = have.union(spark.createDataFrame([("z1",), ("z1",), ("z2",)], "l string")).withColumn("connect_target", F.lit("localhost"))
    rows = I.new_labels(lk.registry, series).collect()
    assert sorted(r.instance_fqn for r in rows) == ["z1", "z2"] and rows[0].auth_mode == "integrated"


# --------------------------------------------------------------- T7, T8
def test_redelivered_rows_are_added_once(spark, scratch):
    from fleetpulse.streaming import jobs

    lk, src, work = DerivedLake(spark, SF), os.path.join(scratch, "src"), os.path.join(scratch, "work")
    p = lk.pings.filter("day <= 6").coalesce(1)
    sink = jobs.DedupSink(spark, work, S.PINGS, ["instance_id", "collected_at"], S.HOT_PARTITIONS)
    want = p.dropDuplicates(["instance_id", "collected_at"]).count()
    for part in ("day <= 3", "day >= 3", "day = 1"):
        I.partitioned_append(p.filter(part), src, S.HOT_PARTITIONS)
        jobs.run_sink(jobs.read_stream(spark, src, S.PINGS, 4), sink, os.path.join(work, "checkpoint"), partitions=2)
    assert sink.rows().count() == want
    sink(p, 0)  # a replayed batch
    assert sink.rows().count() == want
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"


def test_counter_state_is_bounded_and_replay_adds_nothing(spark, scratch):
    from fleetpulse.streaming import jobs

    rows = lambda *r: spark.createDataFrame([(k, 5, dt.datetime(2024, 1, d, h), *[float(v)] * 4) for k, d, h, v in r], jobs.BUCKET)
    sink = jobs.CounterDeltaSink(spark, scratch, keep_days=3)
    sink(rows((1, 1, 0, 10), (1, 1, 1, 30), (2, 1, 0, 5)), 0)
    sink(rows((1, 2, 0, 70)), 1)
    sink(rows((1, 2, 0, 70)), 1)
    got = sorted((r.instance_id, r.coll_hr.day, r.coll_hr.hour) for r in sink.latencies().collect())
    assert got == [(1, 1, 1), (1, 2, 0)] and sink.state().count() == 2
    sink(rows((1, 9, 0, 90)), 2)  # instance 2 was last heard of more than 3 days before
    assert [r.instance_id for r in sink.state().collect()] == [1]
    assert len(os.listdir(os.path.join(scratch, "data", "state"))) == 1  # older versions are gone
    sink(rows((2, 9, 1, 50)), 3)  # starts anew
    assert sink.latencies().count() == 3
