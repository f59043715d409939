"""Vectors in blocks: what the searches over whole vector tables share.

A table's vectors are dealt by a hash of their id and components into partitions, sorted there, and cut into blocks of
bounded size; a lost task rebuilds the same blocks. Every candidate block belongs to one slot, and blocks of queries are
copied to every slot, one copy at a time. A task holds the candidates of a slot, as many as ``SLOT_CELLS`` components on
average, while the query blocks pass by: pairs of blocks are never written out.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest size of an integer score; a larger one counts as this.
TOP = (1 << 63) - 1
FIELDS = ("ids", "marks", "dims", "cells")
_BLOCK = "number int, ids binary, marks binary, dims int, cells binary"
_SENT = "slot int, asked boolean, block long, ids binary, marks binary, dims int, cells binary"
#: Components a slot has on average, at most and (as long as there are enough tasks) at least.
SLOT_CELLS = 1 << 24
LEAST_CELLS = 1 << 18
#: Bytes of an Arrow batch of copies of query blocks, and of the blocks that a task takes at once.
COPIES = 1 << 22
BATCH = 1 << 24


class Block(NamedTuple):
    """Vectors as rows of ``cells`` (float32 if that is exact, else float64; shorter ones padded with zeros), with ids and
    ``width`` longs of marks each."""

    ids: np.ndarray
    marks: np.ndarray
    cells: np.ndarray


def sound(vectors: DataFrame, vec_id: str, embedding: str, *marks: Column) -> DataFrame:
    """(vec_id, v, marks) of the rows with an id, no null mark, and only finite components; components as floats or doubles."""
    finite = F.forall(embedding, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    held = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & finite)
    longs = F.array(*(m.cast("long") for m in marks)) if marks else F.array().cast("array<long>")
    single = held.select(embedding).schema[0].dataType.simpleString() == "array<float>"  # half the bytes, and the same numbers
    v = F.col(embedding) if single else F.transform(embedding, lambda e: e.cast("double"))
    rows = held.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), longs.alias("marks"))
    return rows.where(F.forall("marks", lambda m: m.isNotNull()))


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = number = 0

        def made(rows: pa.Table) -> pa.RecordBatch:
            ids = rows.column(0).to_numpy().astype(np.int64)
            lists = rows.column(1).combine_chunks()
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            dims = int(sizes.max(initial=0))
            cells = np.zeros((len(ids), dims))
            cells[np.arange(dims) < sizes[:, None]] = flat
            with np.errstate(over="ignore"):
                half = cells.astype(np.float32)
            cells = half if (half == cells).all() else cells
            marks = rows.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([marks.tobytes()], pa.binary()), pa.array([dims], pa.int32()),
                 pa.array([cells.tobytes()], pa.binary())], names=["number", *FIELDS])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - count)
                held.append(part)
                at, count = at + part.num_rows, count + part.num_rows
                if count == size:
                    yield made(pa.Table.from_batches(held))
                    held, count, number = [], 0, number + 1
        if held:
            yield made(pa.Table.from_batches(held))

    return run


def _copied(size: int, slots: int):
    """Rows -> blocks, each copied for every slot in batches of a few, so that not all copies are in memory at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in _cut(size)(batches):
            number, ids = (c[0].as_py() for c in one.columns[:2])
            block = int.from_bytes(hashlib.blake2b(ids + number.to_bytes(4, "big"), digest_size=8).digest(), "big", signed=True)
            step = max(1, COPIES // max(1, one.nbytes))
            for low in range(0, slots, step):
                some = np.arange(low, min(low + step, slots), dtype=np.int32)
                copies = one.take(pa.array(np.zeros(len(some), np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some), pa.array(np.ones(len(some), bool)), pa.array(np.full(len(some), block)), *copies.columns[1:]],
                    names=["slot", "asked", "block", *FIELDS],
                )

    return run


def blocks(rows: DataFrame, size: int, slots: int = 0) -> DataFrame:
    """Blocks of at most ``size`` of the rows (vec_id, v, marks); of each a copy for every slot if ``slots`` are given."""
    key = ("vec_id", "v", "marks")
    dealt = rows.repartition(F.xxhash64(*key)).sortWithinPartitions(*key).select(*key)
    return dealt.mapInArrow(_copied(size, slots), _SENT) if slots else dealt.mapInArrow(_cut(size), _BLOCK)


def _unpack(values) -> Block:
    ids, marks, dims, cells = values
    ids = np.frombuffer(ids, np.int64)
    kind = np.float32 if len(cells) == 4 * len(ids) * dims else np.float64
    return Block(ids, np.frombuffer(marks, np.int64).reshape(len(ids), -1), np.frombuffer(cells, kind).reshape(len(ids), dims))


def grown(x: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """x with zeros below and to the right (of Python integers, Python zeros)."""
    if x.shape == (rows, columns):
        return x
    out = np.zeros((rows, columns), x.dtype)
    out[: x.shape[0], : x.shape[1]] = x
    return out


def padded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with the columns of the wider one."""
    wide = max(a.shape[1], b.shape[1])
    return grown(a, len(a), wide), grown(b, len(b), wide)


def slots_of(vectors: DataFrame, embedding: str) -> int:
    """Slots for the vectors of a table: few, since queries are copied to each and each adds its lists of k."""
    size = F.greatest(F.size(embedding), F.lit(0)).cast("long")
    cells = vectors.agg(F.sum(size)).first()[0] or 0
    tasks = 4 * vectors.sparkSession.sparkContext.defaultParallelism
    return max(1, math.ceil(cells / SLOT_CELLS), min(tasks, math.ceil(cells / LEAST_CELLS)))


def _give_back() -> None:
    """Memory that the worker has freed goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def meet(
    queries: DataFrame, held: DataFrame, search: Callable[[Block], object], schema: str, *, query_block: int, held_block: int, slots: int,
    ready: Callable[[list[Block]], list] = list,
) -> DataFrame:
    """What ``search`` finds: for every block of queries a task makes ``search(block)``, calls its ``add(block)`` with each
    block of ``held`` in the task's slot (in the form ``ready`` gives the slot's blocks, once), and emits the rows of its
    ``result()`` (a list of arrays, as in ``schema``)."""
    queries.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    number = F.xxhash64("ids", "number")
    slot = F.pmod(number, F.lit(slots)).cast("int").alias("slot")
    dealt = blocks(held, held_block).select(slot, F.lit(False).alias("asked"), number.alias("block"), *FIELDS)
    asked = blocks(queries, query_block, slots)
    # more partitions than slots, so that few slots share one
    met = dealt.union(asked).repartition(4 * slots, "slot").sortWithinPartitions("slot", "asked", "block", "ids")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, made = None, [], None
        for batch in batches:
            for row in range(batch.num_rows):
                slot, query, _, *cells = (c[row].as_py() for c in batch.columns)
                if slot != now:
                    now, own, made = slot, [], None
                if not query:
                    own.append(_unpack(cells))
                    continue
                if made is None:
                    made, own = ready(own), []
                    _give_back()
                if made:
                    going = search(_unpack(cells))
                    for block in made:
                        going.add(block)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in going.result()], names=names)

    return met.mapInArrow(run, schema)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is built and checkpointed inside leaves no shuffle files behind."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def whole(cells: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, ``scale`` a power of two: int64, or Python integers where one is too large."""
    peak = np.abs(cells).max(initial=0)
    if peak < 2**52 / scale:
        return np.floor(cells * scale).astype(np.int64)
    flat = [int(x) * scale if abs(x) >= 2**53 else int(np.floor(x * scale)) for x in cells.ravel().tolist()]
    return np.array(flat, dtype=object).reshape(cells.shape)


def largest(cells: np.ndarray) -> np.ndarray:
    """Size of the largest component of each row, as a float (a little more for Python integers)."""
    if not cells.shape[1]:
        return np.zeros(len(cells))
    return np.array([float(x) for x in np.abs(cells).max(axis=1)]) * (1 + 1e-9)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, highest first, ties to the smaller id."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


class Lists:
    """The k best (score, id) of each of some keys, best first, ties to the smaller id; places not taken hold the lowest score."""

    def __init__(self, keys: int, k: int):
        self.k, self.count = k, np.zeros(keys, np.int64)
        self.scores, self.names = np.full((keys, k), -TOP), np.full((keys, k), TOP)

    def full(self, keys: np.ndarray) -> np.ndarray:
        return self.count[keys] >= self.k

    def add(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Takes scores (longs) of the keys."""
        last, name = self.scores[keys, -1], self.names[keys, -1]
        new = (scores > last) | (scores == last) & (ids < name) | ~self.full(keys)
        if not new.any():
            return
        order = np.flatnonzero(new)
        order = order[np.argsort(keys[order], kind="stable")]
        keys, scores, ids = keys[order], scores[order], ids[order]
        own, first, count = np.unique(keys, return_index=True, return_counts=True)
        if count.max() > 8 * self.k:  # few of them can stay
            order = np.lexsort((ids, -scores, keys))
            order = order[np.arange(len(keys)) - np.repeat(first, count) < self.k]
            keys, scores, ids = keys[order], scores[order], ids[order]
            own, first, count = np.unique(keys, return_index=True, return_counts=True)
        shape = (len(own), self.k + int(count.max()))
        all_scores, all_names = np.full(shape, -TOP), np.full(shape, TOP)
        all_scores[:, : self.k], all_names[:, : self.k] = self.scores[own], self.names[own]
        row, place = np.repeat(np.arange(len(own)), count), np.arange(len(keys)) - np.repeat(first, count)
        all_scores[row, self.k + place], all_names[row, self.k + place] = scores, ids
        order = np.lexsort((all_names, -all_scores), axis=1)[:, : self.k]
        self.scores[own], self.names[own] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_names, order, 1)
        self.count[own] = np.minimum(self.k, self.count[own] + count)

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, score, id) of all that is held."""
        held = np.arange(self.k) < self.count[:, None]
        return np.repeat(np.arange(len(self.count)), self.count), self.scores[held], self.names[held]


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of what is true (numpy finds it much faster in one dimension)."""
    return np.divmod(np.flatnonzero(mask), max(1, mask.shape[1]))


def recut(blocks: list[Block], key: Callable[[Block], np.ndarray], size: int) -> list[Block]:
    """The rows of the blocks by length without zeros at the end (a power of two), then by key, in blocks of ``size`` rows."""
    if not blocks:
        return []
    keys, length = np.concatenate([key(b) for b in blocks]), np.concatenate([_lengths(b.cells) for b in blocks])
    order = np.lexsort((keys, np.frexp(length)[1]))
    first = np.cumsum([0, *(len(b.ids) for b in blocks)])
    made = []
    for low in range(0, len(order), size):
        part = order[low : low + size]
        of = np.searchsorted(first, part, "right") - 1
        wide, kind = int(length[part].max()), np.result_type(*(b.cells for b in blocks))
        ids, marks, cells = np.empty(len(part), np.int64), np.empty((len(part), blocks[0].marks.shape[1]), np.int64), np.zeros((len(part), wide), kind)
        for n in np.unique(of).tolist():
            to, at, block = of == n, part[of == n] - first[n], blocks[n]
            ids[to], marks[to] = block.ids[at], block.marks[at]
            cells[to, : block.cells.shape[1]] = block.cells[at, :wide]
        made.append(Block(ids, marks, cells))
    return made


def _lengths(cells: np.ndarray) -> np.ndarray:
    if not cells.shape[1]:
        return np.zeros(len(cells), np.int64)
    held = cells != 0
    return np.where(held.any(axis=1), cells.shape[1] - held[:, ::-1].argmax(axis=1), 0)


def slim(x: np.ndarray) -> np.ndarray:
    """Integers in the smallest kind that holds them."""
    peak = np.abs(x).max(initial=0)
    return x.astype(np.float32) if peak < 2**24 else x.astype(np.float64) if peak < 2**53 else x


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """Python integers of whole numbers."""
    return np.array([int(v) for v in x.ravel().tolist()], dtype=object).reshape(x.shape)
