"""Collision-counting search, Strassen negatives and conversation repair against brute force."""

import hashlib
import itertools
import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetpulse.llm import bond_topk, collision_knn, strassen_negatives, turn_repair, vector_blocks
from fleetpulse.llm.common import prepare

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    prepare(spark)


def odd_vectors(seed, n=300, dims=12):
    rnd = random.Random(seed)
    rows = [(i, [rnd.choice([-0.5, 0.25, rnd.uniform(-1, 1)]) for _ in range(dims)], rnd.randrange(3)) for i in range(n)]
    same = [0.125] * dims
    rows += [(400 + i, same, 1) for i in range(6)] + [(500, same, 2), (501, [0.5] * 5, 1), (600, [300000.0] + [0.0] * (dims - 1), 0)]
    rows += [(601, [3e38, 1.0] + [0.0] * (dims - 2), 1), (602, [2.5e38, -1.0] + [0.0] * (dims - 2), 2)]
    return rows + [
        (700, None, 1), (701, [None] * dims, 1), (702, [float("nan")] * dims, 1), (703, [float("inf")] + [0.0] * (dims - 1), 1),
        (800, [0.0] * dims, 1), (900, [], 1), (None, same, 1), (1000, same, None), (10, rows[10][1], rows[10][2]), (11, rows[11][1], rows[11][2]),
    ]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return df.withColumns({"score": F.lit("clash"), "rank": F.lit(1), "slot": F.lit(2), "v": F.lit(3), "marks": F.lit(4), "place": F.lit(5)})


def held(rows, dims=12):
    def fine(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v)

    return [(i, [float(np.float32(x)) for x in v] + [0.0] * (dims - len(v)), c) for i, v, c in rows if i is not None and fine(v)]


def test_nearest_with_few_rows_is_exact(spark):
    rows = [r for r in odd_vectors(3, n=40) if r[0] not in (601, 602)]
    own = [r for r in held(rows) if any(r[1])]
    want = []
    for q in sorted({i for i, _, _ in own if i % 100 == 0}):
        x = np.array(min(v for i, v, _ in own if i == q))
        found = sorted((float(np.sqrt(np.square(np.array(v) - x).sum())), i) for i, v, _ in own if i != q)[:10]
        want += [(q, n + 1, i, d) for n, (d, i) in enumerate(found)]
    got = [tuple(r) for r in collision_knn.nearest(frame(spark, rows), lambda i: i % 100 == 0, slots=3).orderBy("query_id", "rank").collect()]
    assert got == want
    few = frame(spark, rows[:4] + rows[:1])
    assert [r.vec_id for r in collision_knn.nearest(few, lambda i: i % 100 == 0).orderBy("rank").collect()] != []
    assert collision_knn.nearest(few, lambda i: i % 100 == 0).count() == 3
    assert collision_knn.nearest(few.limit(0), lambda i: i % 100 == 0).count() == 0


def test_nearest_recall_and_scores(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    far = table.limit(200).select((F.col("vec_id") + 10_000).alias("vec_id"), F.transform("embedding", lambda x: x * 1e30).alias("embedding"), "label")
    near = table.limit(200).select((F.col("vec_id") + 20_000).alias("vec_id"), F.transform("embedding", lambda x: x * F.lit(1e-20).cast("float")).alias("embedding"), "label")
    copies = table.where("vec_id = 7").select(F.explode(F.sequence(F.lit(30_000), F.lit(30_300))).alias("vec_id"), "embedding", "label")
    mixed = table.union(far).union(near).union(copies)
    rows = mixed.collect()
    ids, cells = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    asked = lambda i: (i % 100 == 0) | (i == 7)
    got = {}
    for r in collision_knn.nearest(mixed, asked, slots=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    hits = total = 0
    for q in ids[(ids % 100 == 0) | (ids == 7)].tolist():
        d = np.sqrt(np.square(cells - cells[ids == q][0]).sum(axis=1))
        true = sorted((a, i) for a, i in zip(d.tolist(), ids.tolist()) if i != q)
        assert got[q] == sorted(got[q]) and len(got[q]) == 10
        assert set(got[q]) <= set(true)
        hits, total = hits + len(set(got[q]) & set(true[:10])), total + 10
    assert hits >= 0.95 * total
    assert got[7][:5] == [(0.0, 30_000 + i) for i in range(5)]


def test_collisions_needed():
    assert collision_knn.needed(4, 100.0, 0.01) == 4 and collision_knn.needed(10, 1e-9, 0.5) == 0
    index = collision_knn.Index(np.random.default_rng(1).normal(size=(50, 3)))
    for targets in (np.zeros(collision_knn.PROJECTIONS), index.values[:, 7], np.full(collision_knn.PROJECTIONS, 1e9)):
        for after, side in ((False, "left"), (True, "right")):
            want = [np.searchsorted(v, t, side) for v, t in zip(index.values, targets)]
            assert index.places(targets, after).tolist() == want


def test_strassen_equals_product():
    rng = np.random.default_rng(2)
    for n, m, p in ((1, 1, 1), (5, 0, 3), (64, 64, 64), (37, 70, 129), (130, 33, 3)):
        a, b = rng.integers(-(2**28), 2**28, (n, m)), rng.integers(-(2**28), 2**28, (m, p))
        for leaf in (1, 8, 32):
            assert (strassen_negatives.strassen(a, b, leaf) == a @ b).all()
    big = rng.integers(-5, 5, (20, 20)).astype(object) * 10**40
    assert (strassen_negatives.strassen(big, big, 4) == big @ big).all()


@pytest.mark.parametrize("blocks", [(256, 4096), (3, 16)])
def test_negatives_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(strassen_negatives, "ANCHOR_BLOCK", blocks[0])
    monkeypatch.setattr(strassen_negatives, "CANDIDATE_BLOCK", blocks[1])
    rows = odd_vectors(5)
    own = [(i, [int(x) * 256 if abs(x) > 2**60 else int(np.floor(256 * x)) for x in v], c) for i, v, c in held(rows) if c is not None]
    top = vector_blocks.TOP
    want = []
    for a in sorted({i for i, _, _ in own if i % 100 == 0}):
        label, x = min((c, v) for i, v, c in own if i == a)
        scored = sorted((-max(-top, min(top, sum(p * q for p, q in zip(x, v)))), i, c) for i, v, c in own if i != a)
        for n, (s, p, _) in enumerate([z for z in scored if z[2] == label][:5]):
            window = [(t, i) for t, i, c in scored if c != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            want += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(window)]
    got = sorted(tuple(r) for r in strassen_negatives.mine(frame(spark, rows), lambda i: i % 100 == 0, slots=3).collect())
    assert got == sorted(want) and {r[0] for r in want} >= {0, 100, 600}
    assert strassen_negatives.mine(frame(spark, rows).limit(0), lambda i: i % 100 == 0).count() == 0


# --- conversations ------------------------------------------------------------------------------------------------------


def least(kinds):
    """(cost, audit) by least suffixes, with strings."""

    @lru_cache(None)
    def best(i, state, fresh):
        out = [(0, "")] if i == len(kinds) and state in (0, 3) else []
        if fresh < 2:
            for x in "ua":
                if (state, x) in turn_repair.NEXT:
                    c, s = best(i, turn_repair.NEXT[state, x], fresh + 1)
                    out.append((c + 3, "I" + s))
        if i < len(kinds):
            k = turn_repair.KINDS.index(kinds[i])
            initial, fault = "sua?"[k // 4], k % 4
            late = 3 if fault == 1 else 0
            ways = [(4, "D", state)]
            if fault < 2:
                ways += [(3 + late, "R", turn_repair.NEXT[state, x]) for x in "ua" if (state, x) in turn_repair.NEXT]
                ways += [(late, "K", turn_repair.NEXT[state, initial])] if (state, initial) in turn_repair.NEXT else []
            for c, x, after in ways:
                d, s = best(i + 1, after, 0)
                out.append((c + d, x + s))
        return min(out, default=(10**9, ""))

    return best(0, 0, 0)


def cost_of(kinds, audit):
    at, cost = 0, 0
    for x in audit:
        cost += {"I": 3, "D": 4, "R": 3, "K": 0}[x]
        if x != "I":
            cost += 3 if x != "D" and turn_repair.KINDS.index(kinds[at]) % 4 == 1 else 0
            at += 1
    assert at == len(kinds)
    return cost


def test_crossings_find_the_least_audit():
    rnd = random.Random(1)
    some = [[turn_repair.KINDS[k] for k in p] for n in range(4) for p in itertools.product((0, 1, 4, 5, 8, 9, 12, 2), repeat=n)]
    some += [[rnd.choice(turn_repair.KINDS) for _ in range(rnd.randrange(4, 60))] for _ in range(400)]
    some += [[rnd.choice("abeifj") for _ in range(rnd.randrange(4, 40))] for _ in range(400)]
    for kinds in some:
        own, states = turn_repair.letters("".join(kinds), 0, None)
        audit = "".join(own) + turn_repair.CLOSE[states[-1]][1]
        assert (cost_of(kinds, audit), audit) == least(tuple(kinds)), kinds


def expected(rows):
    """The contract's result by plain Python."""
    by = {}
    for conv, turn, role, text in rows:
        said = by.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        damage = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if damage == 0:
            continue
        text = "" if damage == 1 else text.translate({ord(c): None for c in ".!?"}) if damage == 2 else text
        said += [(turn, "user" if damage == 4 else role, text)] * (2 if damage == 3 else 1)
    out = {}
    for conv, said in by.items():
        digest = lambda r: hashlib.sha256(
            b"".join(f"{len(x.encode())}:{x}".encode() for x in ("" if conv is None else f"c{conv}", r[1])) + r[2].encode()
        ).digest()
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r)))
        counts, kinds, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, [], set()
        for _, role, text in said:
            t = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            kinds.append(turn_repair.KINDS[("sua".index(role[0]) if role and role[0] in "sua" else 3) * 4 + turn_repair.FAULTS.index(fault)])
        cost, audit = least(tuple(kinds)) if kinds else (0, "")
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(said, said[1:])]
        turns = [r[0] for r in said if r[0] is not None]
        length = len(audit.replace("D", ""))
        lines, at = [], 0
        for x in audit:
            given = "user" if len(lines) % 2 == length % 2 else "assistant"
            if x in "KR":
                lines.append(f"{said[at][1] if x == 'K' else given}:{said[at][2]}")
            elif x == "I":
                lines.append(f"{given}:")
            at += x != "I"
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts.values(), sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


@pytest.mark.parametrize("segment, fan", [(4096, 1024), (3, 2)])
def test_repair_equals_brute_force(spark, segment, fan):
    rnd = random.Random(4)
    texts = ["Yes.", "No", "", None, " \n ", "Why?", "A. b! c?", "Ünd ß\t", "x" * 20000 + ".", "? ", "one\ntwo.", "K:"]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "ärger", "User"]
    rows = [(c, t, rnd.choice(roles[:6]), rnd.choice(texts)) for c in range(60) for t in range(rnd.randrange(1, 9))]
    rows += [(1000, t, rnd.choice(roles), rnd.choice(texts + [f"t{t}."])) for t in range(220)] + [(1001, t, "user", f"s{t}.") for t in range(90)]
    rows += [(None, t, rnd.choice(roles), "n.") for t in (None, None, 3, 3, -5, 2**40)] + [(1002, None, "user", "a."), (1002, None, "user", "a.")]
    rows += [(1003, 5, "user", "a."), (1003, 5, "user", "a."), (1003, 5, "assistant", "b."), (1004, -(2**63), "user", "p."), (1004, 2**63 - 1, "user", "q.")]
    lost = next(c for c in itertools.count(2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "gone."))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    df = df.withColumns({c: F.lit("clash") for c in ("conv", "place", "kind", "said", "node", "number", "audit", "damage")})
    got = {r[0]: tuple(r)[1:] for r in turn_repair.report(df, segment=segment, fan=fan).collect()}
    want = expected(rows)
    if abs(want[1004][0]) > vector_blocks.TOP:
        want[1004] = (vector_blocks.TOP, *want[1004][1:])
    assert got == want
    assert turn_repair.report(df.limit(0)).count() == 0


# --- blocks that meet ---------------------------------------------------------------------------------------------------


def test_pairs_of_blocks_are_not_written(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    for found in (bond_topk.top_k(table, lambda i: i % 100 == 0), collision_knn.nearest(table, lambda i: i % 100 == 0)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Join" not in plan
    rows = pa.RecordBatch.from_pydict({"vec_id": [*range(1000)], "v": [[0.1] * 128] * 1000, "marks": [[]] * 1000}, pa.schema({"vec_id": pa.int64(), "v": pa.list_(pa.float64()), "marks": pa.list_(pa.int64())}))
    copies = list(vector_blocks._copied(1024, 50)(iter([rows])))  # of a MB each
    assert max(c.num_rows for c in copies) <= 4 and [s for c in copies for s in c.column(0).to_pylist()] == [*range(50)]


def test_slots_grow_with_the_table(spark, monkeypatch):
    table = spark.range(1000).select(F.array_repeat(F.lit(0.5), 64).alias("embedding"))
    assert vector_blocks.slots_of(table, "embedding") == 1 and vector_blocks.slots_of(table.limit(0), "embedding") == 1
    monkeypatch.setattr(vector_blocks, "LEAST_CELLS", 8000)
    assert vector_blocks.slots_of(table, "embedding") == 8
    monkeypatch.setattr(vector_blocks, "SLOT_CELLS", 640)
    assert vector_blocks.slots_of(table, "embedding") == 100


@pytest.mark.parametrize("size", [1.0, 3000.0, 2.0**17])
@pytest.mark.parametrize("kind", ["spread", "clusters", "copies"])
def test_bounds_keep_the_best(monkeypatch, size, kind):
    monkeypatch.setattr(bond_topk, "TILE", (7, 90))
    monkeypatch.setattr(bond_topk, "CANDIDATE_BLOCK", 300)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 70))
    if kind != "spread":
        x = x[:6][rng.integers(0, 6, 1500)] + (kind == "clusters") * rng.normal(0, 0.03, x.shape)
    x *= size / np.abs(x).max()
    x[3, 40:], x[5] = 0, 0
    ids = rng.integers(0, 1400, 1500)
    part = [vector_blocks.Block(ids[i : i + 400], np.zeros((len(ids[i : i + 400]), 0), np.int64), x[i : i + 400]) for i in range(0, 1500, 400)]
    own = np.unique(ids, return_index=True)[1][:30]
    search = bond_topk.Search(vector_blocks.Block(ids[own], np.zeros((30, 0), np.int64), x[own]), 10)
    for block in bond_topk.ready(part):
        search.add(block)
    exact = vector_blocks.whole(x, 1024).astype(object)
    got = sorted(zip(*(a.tolist() for a in search.result())))
    want = []
    for q in own.tolist():
        score = (exact @ exact[q]).tolist()
        want += [(int(ids[q]), i, -s) for s, i in sorted((-s, i) for s, i in zip(score, ids.tolist()) if i != ids[q])[:10]]
    assert got == sorted(want)


@pytest.mark.parametrize("size", [1.0, 1e-20, 1e30, 1e-150, 1e150])
def test_collisions_on_ranks(monkeypatch, size):
    monkeypatch.setattr(collision_knn, "FIRST", 100)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 24)) * size
    x[300:340] = x[7]  # copies
    x[900:1100] *= 1e-3
    ids = np.arange(2000)
    x, ids = np.concatenate((x, x[:20])), np.concatenate((ids, ids[:20]))
    x = x.astype(np.float32) if 1e-30 < size < 1e31 else x
    part = [vector_blocks.Block(ids[i : i + 700], np.zeros((len(ids[i : i + 700]), 0), np.int64), x[i : i + 700]) for i in range(0, len(ids), 700)]
    made = collision_knn.ready(part)
    assert [m.codes is None for m in made] == [True, False, False, False] and sum(len(m.ids) for m in made) == len(ids)
    search = collision_knn.Search(vector_blocks.Block(ids[:60], np.zeros((60, 0), np.int64), x[:60]), 10)
    for m in made:
        search.add(m)
    got = {}
    for q, i, d in zip(*(a.tolist() for a in search.result())):
        got.setdefault(q, []).append((d, i))
    hits = 0
    for q in range(60):
        true = sorted(zip(np.sqrt(np.square(x.astype(float) - x[q]).sum(axis=1)).tolist(), ids.tolist()))
        true = [t for t in true if t[1] != q]
        assert got[q] == sorted(got[q]) and len(got[q]) == 10 and set(got[q]) <= set(true)
        hits += len(set(got[q]) & set(true[:10]))
    assert hits >= 0.97 * 600 and got[7] == [(0.0, 300 + i) for i in range(10)]
    assert collision_knn.ready([]) == []


def test_tiles_of_negatives_are_not_written(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    plan = strassen_negatives.mine(table, lambda i: i % 100 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "slot" not in "".join(x for x in plan.split("\n") if "Join" in x)


@pytest.mark.parametrize("size", [1.0, 3000.0, 2.0**17, 2.0**40])
def test_tiles_keep_the_best(monkeypatch, size):
    monkeypatch.setattr(strassen_negatives, "TILE", 130)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1200, 40)) + 2 * rng.normal(size=(8, 40))[rng.integers(0, 8, 1200)]
    x *= size / np.abs(x).max()
    x[50:60], x[4, 20:] = x[3], 0
    ids, labels = rng.integers(0, 1100, 1200), rng.integers(0, 4, 1200)
    block = lambda at, marks: vector_blocks.Block(ids[at], marks[at], x[at])
    tiles = strassen_negatives.ready([block(slice(i, i + 500), labels[:, None]) for i in range(0, 1200, 500)])
    assert strassen_negatives.ready([]) == [] and {t.label for t in tiles} >= {0, 1, 2, 3}
    own = np.unique(ids, return_index=True)[1][:70]
    first = strassen_negatives.Positives(block(own, labels[:, None]), 3)
    for t in tiles:
        first.add(t)
    top = vector_blocks.TOP
    exact = vector_blocks.whole(x, 256).astype(object)
    marks, want, got = np.zeros((1200, 10), np.int64), [], {}
    for q, i, s in sorted(zip(*(a.tolist() for a in first.result())), key=lambda z: (z[0], -z[2], z[1])):
        got.setdefault(q, []).append((-s, i))
    for q in own.tolist():
        scored = sorted((-max(-top, min(top, s)), i, c) for s, i, c in zip((exact @ exact[q]).tolist(), ids.tolist(), labels.tolist()) if i != ids[q])
        best = [(s, i) for s, i, c in scored if c == labels[q]][:3]
        assert got.get(int(ids[q]), []) == best
        marks[q] = [labels[q], *(v for n, (s, i) in enumerate(best) for v in (n + 1, i, -s)), *[0] * (9 - 3 * len(best))]
        for n, (s, i) in enumerate(best):
            inside = [(t, j) for t, j, c in scored if c != labels[q] and 80 * -s <= 100 * -t <= 100 * -s][:3]
            want += [(int(ids[q]), n + 1, i, -s, j, -t) for t, j in inside]
    second = strassen_negatives.Negatives(block(own, marks), 3, 80)
    for t in tiles:
        second.add(t)
    assert sorted(zip(*(a.tolist() for a in second.result()))) == sorted(want) and want
