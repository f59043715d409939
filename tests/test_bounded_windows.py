"""Bounded-group windows (blocks + halo) equal plain per-key windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetpulse.operators.windows import key_ordinal, lag_bounded, run_length_since, trailing_avg_bounded
from fleetpulse.plans import extras as G
from fleetpulse.sources.derived import DerivedLake

SF = "/root/testdata/sf0.001"


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_key_ordinal_matches_row_number(spark):
    p = DerivedLake(spark, SF).pings.select("instance_id", "collected_at", "response_time_ms")
    got = key_ordinal(p, ["instance_id"], ["collected_at", "response_time_ms"])
    w = Window.partitionBy("instance_id").orderBy("collected_at", "response_time_ms")
    want = p.withColumn("_ord", F.row_number().over(w))
    assert _rows(got, ["instance_id", "collected_at", "_ord"]) == _rows(want, ["instance_id", "collected_at", "_ord"])


def test_lag_bounded_small_blocks(spark):
    p = DerivedLake(spark, SF).pings.select("instance_id", "collected_at", "response_time_ms")
    got = lag_bounded(p, ["instance_id"], ["collected_at"], ["response_time_ms"], block=5)
    w = Window.partitionBy("instance_id").orderBy("collected_at")
    want = p.withColumn("prev_response_time_ms", F.lag("response_time_ms").over(w))
    cols = ["instance_id", "collected_at", "prev_response_time_ms"]
    assert _rows(got, cols) == _rows(want, cols)


def test_ping_early_warning_small_blocks_equal_plain(spark):
    pings = DerivedLake(spark, SF).pings
    got = G.ping_early_warning(pings, block=13)
    order = ["collected_at", "response_time_ms", "is_success"]
    w = Window.partitionBy("instance_id").orderBy(*order)
    isl = pings.select("instance_id", *order,
                       F.sum(F.col("is_success").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("g"),
                       F.avg("response_time_ms").over(w.rowsBetween(-11, 0)).alias("avg_response_12"))
    wi = Window.partitionBy("instance_id", "g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    want = isl.select("instance_id", "collected_at", "avg_response_12",
                      F.sum((~F.col("is_success")).cast("int")).over(wi).alias("failure_run"))
    cols = ["instance_id", "collected_at", "failure_run", "avg_response_12"]
    assert _rows(got, cols) == _rows(want, cols)


def test_run_length_carries_across_blocks(spark):
    rows = [(1, i, i in (0, 9)) for i in range(12)] + [(2, i, False) for i in range(4)]
    df = spark.createDataFrame(rows, "k int, t int, ok boolean")
    o = key_ordinal(df, ["k"], ["t"])
    got = {(r.k, r.t): r.run for r in run_length_since(o, ["k"], "ok", "run", block=3).collect()}
    assert [got[(1, i)] for i in range(12)] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 0, 1, 2]
    assert [got[(2, i)] for i in range(4)] == [1, 2, 3, 4]
    avg = {(r.k, r.t): r.a for r in trailing_avg_bounded(o, ["k"], 3, "t", "a", block=4).collect()}
    assert avg[(1, 4)] == 3.0 and avg[(1, 0)] == 0.0 and avg[(1, 1)] == 0.5


def test_hot_key_is_split_across_tasks(spark):
    """One key with a third of all rows: its rows lie in many cells, the ordinals are exact, and each window block holds
    at most ``block`` of its rows."""
    from fleetpulse.operators.windows import with_blocks, with_cells

    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97 + 1).alias("k"),
        F.col("id").alias("t"),
    )
    cells = with_cells(df, ["t"], cells=20).filter("k = 0").groupBy("_cell").count()
    assert cells.count() >= 15 and cells.agg(F.max("count")).first()[0] <= n // 3 // 10
    o = key_ordinal(df, ["k"], ["t"])
    hot = o.filter("k = 0")
    # ordinals stitched across those cells are exactly 1..n/3, in time order
    assert hot.agg(F.min("_ord"), F.max("_ord"), F.countDistinct("_ord")).first() == (1, n // 3, n // 3)
    assert hot.filter(F.col("_ord") != F.col("t") / 3 + 1).count() == 0
    blocks = with_blocks(hot, 1, 1000).groupBy("_blk").count()
    assert blocks.agg(F.max("count")).first()[0] <= 1001
    assert "Checkpoint" not in o._jdf.queryExecution().toString() and "RDDScan" not in o._jdf.queryExecution().toString()


def test_cells_rise_with_the_order(spark):
    """Positions of every kind of leading column, with nulls, shared beginnings and one value that holds most rows."""
    import datetime as dt

    from fleetpulse.operators.windows import dense_rank_global, with_cells

    at = dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 50 == 0 else f"customer#{i % 700:06d}", at if i % 4 else at + dt.timedelta(hours=i), i % 2 == 0, float(i % 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "i int, s string, t timestamp_ntz, b boolean, d double").repartition(5)
    for order in (["s", "i"], ["t", "i"], ["b", "t", "i"], ["d", "s", "i"], ["i"]):
        want = [r.i for r in df.orderBy(*order).collect()]
        ranked = dense_rank_global(df, order, cells=16).collect()
        assert [r.i for r in sorted(ranked, key=lambda r: r.rank)] == want and {r.rank for r in ranked} == set(range(1, 2001))
        if order[0] != "b":  # two columns that tell few rows apart
            assert with_cells(df, order, cells=16).groupBy("_cell").count().agg(F.max("count")).first()[0] <= 2000 * 3 // 16, order
    assert dense_rank_global(df.limit(0), ["i"]).count() == 0 and key_ordinal(df.limit(0), ["s"], ["i"]).count() == 0
