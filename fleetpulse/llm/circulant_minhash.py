"""MinHash near-dedup with circulant permutations (operator 4).

A document's set holds the hashes of its distinct 5-word shingles. Two fixed permutations make all signature coordinates:
the first scatters a shingle over a ring of 2**32 places, and coordinate k is the least value of the second one, shifted
by k places around the ring. Bands of ``ROWS`` coordinates give bucket keys; a pair at the threshold of 0.75 misses all
``BANDS`` buckets with probability (1 - 0.75**4)**32 = 5e-6, and likelier pairs less.

Documents of equal sets form a class, and classes are compared. Within a bucket every class is first compared with the
bucket's least class; the links so confirmed give components. Buckets that then lie in one component are done. In the
others, classes of different components are still compared: pair by pair in buckets of at most ``PAIRED`` classes; in
larger ones in blocks of bounded size, where the classes outside the bucket's largest component meet all of it, inside
one grouped task per block pair that emits confirmed links only. Every comparison is made on full sets; no partner is
capped. Class ids, links and components stay distributed.

Defined cases: null or empty text, or text of white space only, has an empty set, links with nothing and is kept; a text
of one to four words has its whole sequence as the one shingle; rows that repeat a document id count as one document for
links; a null id is never kept; ties go to the smallest id; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.llm.common import mix64, row_blocks, shingle_sets, utf8
from fleetpulse.llm.components import components

ROWS, BANDS = 4, 32
NEED_INTER, NEED_UNION = 100, 75
PAIRED = 48
BLOCK = 256
_RING_CHUNK = 1 << 15
_SKETCH = T.StructType(
    [T.StructField("n", T.LongType()), T.StructField("class", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
)


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation of the ring, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Circulant signatures, a row of ROWS * BANDS coordinates per set (none may be empty)."""
    out = np.empty((len(sets), ROWS * BANDS), np.uint32)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= _RING_CHUNK):
            n += len(sets[j])
            j += 1
        ring = (mix64(np.concatenate(sets[i:j])) >> np.uint64(32)).astype(np.uint32)  # the first permutation
        first = np.concatenate(([0], np.cumsum([len(s) for s in sets[i : j - 1]]))).astype(np.int64)
        for k in range(ROWS * BANDS):
            out[i:j, k] = np.minimum.reduceat(_second(ring + np.uint32(k)), first)
        i = j
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key per band, the band's number included."""
    wide = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = mix64(key ^ wide[:, :, r])
    return key.view(np.int64)


@F.arrow_udf(_SKETCH)
def _sketch(text: pa.Array) -> pa.Array:
    """Set size, class (digest of the set) and band keys of a text; class and bands null without words."""
    data, off = utf8(text)
    sizes, digests, bands = [], [], []
    for i, j in row_blocks(off):
        sets = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
        some = [s for s in sets if len(s)]
        keys = iter(band_keys(signatures(some)).tolist() if some else ())
        for s in sets:
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            bands.append(next(keys) if len(s) else None)
    return pa.StructArray.from_arrays(
        [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
        names=["n", "class", "bands"],
    )


@F.arrow_udf(T.BinaryType())
def _set(text: pa.Array) -> pa.Array:
    """A text's sorted set as bytes."""
    data, off = utf8(text)
    out = []
    for i, j in row_blocks(off):
        out += [s.tobytes() for s in shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i])]
    return pa.array(out, pa.binary())


@F.arrow_udf(T.BooleanType())
def _linked(left: pa.Array, right: pa.Array) -> pa.Array:
    """Whether two full sets reach the threshold."""
    out = []
    for a, b in zip(left, right):
        x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
        if len(x) > len(y):
            x, y = y, x
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        both = int((y[at] == x).sum())
        out.append(NEED_INTER * both >= NEED_UNION * (len(x) + len(y) - both))
    return pa.array(out, pa.bool_())


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("right"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(_linked("left", "right")).select("a", "b")


def _block_links(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between two blocks' classes of different components."""
    sets = [[np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()] for t in (left, right)]
    ids, comps = ([t.column(c).to_numpy() for t in (left, right)] for c in ("id", "comp"))
    sizes = [np.array([len(s) for s in own]) for own in sets]
    pool = np.concatenate(sets[0])
    first = np.concatenate(([0], np.cumsum(sizes[0])[:-1]))
    found_a, found_b = [], []
    for r, own in enumerate(sets[1]):
        at = np.minimum(np.searchsorted(own, pool), len(own) - 1)
        both = np.add.reduceat((own[at] == pool).astype(np.int64), first)
        hit = (NEED_INTER * both >= NEED_UNION * (sizes[0] + len(own) - both)) & (comps[0] != comps[1][r])
        found_a.append(ids[0][hit])
        found_b.append(np.full(int(hit.sum()), ids[1][r]))
    return pa.table({"a": np.concatenate(found_a), "b": np.concatenate(found_b)})


def _large_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links across components in large buckets; ``members`` has key, id, comp."""
    per = members.groupBy("key", "comp").agg(F.count("*").alias("c"))
    whole = per.groupBy("key").agg(F.max_by("comp", "c").alias("main"), F.sum("c").alias("m"), F.max("c").alias("most"))
    blocks = whole.select(
        "key",
        "main",
        F.ceil(F.col("m") / F.lit(BLOCK)).cast("int").alias("n_all"),
        F.ceil((F.col("m") - F.col("most")) / F.lit(BLOCK)).cast("int").alias("n_rest"),
    )
    held = members.join(blocks, "key").join(sets, "id")

    def place(n: str, salt: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), F.col("id")), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - F.lit(1)))

    cols = ["key", "id", "comp", "set"]
    left = held.select(*cols, place("n_all", "all").alias("x"), every("n_rest").alias("y"))
    rest = held.where(F.col("comp") != F.col("main"))
    right = rest.select(*(F.col(c).alias(c) for c in cols), place("n_rest", "rest").alias("y"), every("n_all").alias("x"))
    by = ("key", "x", "y")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_both_sides, "a long, b long")


def _both_sides(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows or not right.num_rows:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    return _block_links(left, right)


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = own.select("doc_id", _sketch("text").alias("s")).select("doc_id", "s.n", "s.class", "s.bands").checkpoint()
    classes = (
        rows.where(F.col("class").isNotNull())
        .groupBy("class")
        .agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        .where(F.col("id").isNotNull())
    )
    banded = classes.select("id", "n", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("least")).where(F.col("m") > 1)
    members = banded.join(buckets, "key").checkpoint()

    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    sets = own.join(wanted, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), _set("text").alias("set"))
    sets = sets.where(F.length("set") > 0).dropDuplicates().checkpoint()

    stars = members.where(F.col("id") != F.col("least")).select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    stars = stars.checkpoint()
    links = _confirm(stars, sets).checkpoint()
    roots = components(links)

    placed = members.join(roots, "id", "left").select("key", "id", "n", "m", F.coalesce("root", "id").alias("comp")).checkpoint()
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi"))
    left = placed.join(mixed.select("key"), "key")
    small = left.where(F.col("m") <= PAIRED).groupBy("key").agg(F.collect_list(F.struct("id", "n", "comp")).alias("g"))
    crossing = F.expr(
        f"""flatten(transform(g, x -> transform(filter(g, y -> x.id < y.id and x.comp <> y.comp
            and {NEED_INTER} * least(x.n, y.n) >= {NEED_UNION} * greatest(x.n, y.n)), y -> struct(x.id as a, y.id as b))))"""
    )
    pairs = small.select(F.explode(crossing).alias("p")).select("p.a", "p.b").distinct().join(stars, ["a", "b"], "left_anti")
    more = _confirm(pairs, sets)
    large = left.where(F.col("m") > PAIRED).select("key", "id", "comp")
    more = more.union(_large_links(large, sets))

    up = roots.select(F.col("id").alias("x"), "root")
    lifted = (
        more.join(up.withColumnsRenamed({"x": "a", "root": "ra"}), "a", "left")
        .join(up.withColumnsRenamed({"x": "b", "root": "rb"}), "b", "left")
        .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    )
    again = components(lifted).withColumnsRenamed({"id": "comp", "root": "top"})
    named = (
        classes.select("class", "id")
        .join(roots, "id", "left")
        .select("class", "id", F.coalesce("root", "id").alias("comp"))
        .join(again, "comp", "left")
        .select("class", "id", F.coalesce("top", "comp").alias("comp"))
    )
    least = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    by_class = named.join(least, "comp").select("class", "component_id")
    return rows.select("doc_id", "n", "class").join(by_class, "class", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(False)).alias("kept"),
    )
