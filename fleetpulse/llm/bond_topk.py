"""Exact top-k by integer inner product, columnar branch and bound (operator 6).

Vectors are held in blocks, one column of a block per vector and one row per dimension. Scores are accumulated over
blocks of dimensions; what the rest of a vector can still add lies within the product of the two remaining norms, so
after a block of dimensions the queries drop the candidates whose upper bound is below their k-th best lower bound and
go on with the compacted rest. This is done for a tile of queries and candidates at once: queries without any candidate
left and candidates without any query left leave the tile, and where few pairs are left, only those are summed on. The
first bounds are tried later where they dropped little. Every task keeps its running k best per query, and the tasks'
lists of k are merged.

A task holds the candidates of a slot, ordered by the signs of their first components so that tiles are alike, and takes
one block of queries after the other (``vector_blocks.meet``). Nothing is broadcast, and no pair of blocks is written out.

Vectors with components so large that their sums could pass a long skip the bounds: their scores are summed in Python
integers.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows without id; a score
beyond a long counts as the nearest long; shorter vectors count as zero in the missing
dimensions; rows with the query's own id are no candidates of it; a repeated query id is asked once, by its smallest
vector; ties go to the smaller id; fewer candidates than k give shorter lists; an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.vector_blocks import TOP, Block, Lists, largest, meet, padded, places, recut, slim, slots_of, sound, whole, whole_numbers

SCALE = 1024
DIM_BLOCK = 16
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
#: Queries and candidates of a tile, whose scores stay in a core's cache.
TILE = (256, 1024)
#: Pairs are summed on singly where fewer than one in so many is left.
FEW = 200


def _rest_norms(x: np.ndarray) -> np.ndarray:
    """Norm of what comes from each block of dimensions on; row b belongs to dimension b * DIM_BLOCK."""
    starts = range(0, len(x), DIM_BLOCK)
    with np.errstate(over="ignore"):
        square = [np.square(x[s : s + DIM_BLOCK].astype(np.float64)).sum(axis=0) for s in starts]
        return np.sqrt(np.cumsum([np.zeros(x.shape[1]), *square[::-1]], axis=0)[::-1])


class Vectors(NamedTuple):
    """Vectors, a column each, with the norms of what is left and the largest components."""

    ids: np.ndarray
    cells: np.ndarray
    rest: np.ndarray
    largest: np.ndarray


def _vectors(ids: np.ndarray, x: np.ndarray) -> Vectors:
    cells = np.ascontiguousarray(slim(x).T)
    return Vectors(ids, cells, _rest_norms(cells), largest(x))


def _signs(block: Block) -> np.ndarray:
    """The signs of the first components as bits."""
    bits = block.cells[:, :DIM_BLOCK] < 0
    return bits @ (1 << np.arange(bits.shape[1])[::-1]) if bits.shape[1] else np.zeros(len(bits), np.int64)


def ready(blocks: list[Block]) -> list[Vectors]:
    """The candidates of a slot by the signs of their first components, cut again."""
    return [_vectors(b.ids, whole(b.cells, SCALE)) for b in recut(blocks, _signs, CANDIDATE_BLOCK)]


class Search:
    """Running top k of a block of queries (a row each)."""

    def __init__(self, queries: Block, k: int):
        self.ids, self.k = queries.ids, k
        self.x = whole(queries.cells, SCALE)
        self.rest, self.largest = _rest_norms(self.x.T), largest(self.x)
        self.best = Lists(len(self.ids), k)
        self.tiles, self.reach = 0, DIM_BLOCK

    def add(self, block: Vectors) -> None:
        dims = max(self.x.shape[1], len(block.cells))
        limit = (2**62 / max(dims, 1)) ** 0.5
        big_q, big_x = self.largest >= limit, block.largest >= limit
        fine_q, fine_x = np.flatnonzero(~big_q), np.flatnonzero(~big_x)
        if len(fine_q) and len(fine_x):
            self._bounded(fine_q, block if len(fine_x) == len(block.ids) else _vectors(block.ids[fine_x], block.cells.T[fine_x]))
        if not (big_q.any() or big_x.any()):
            return
        q, x = padded(self.x.astype(object), whole_numbers(block.cells.T))
        for r in range(len(self.ids)):
            at = np.flatnonzero((block.ids != self.ids[r]) & (big_x | big_q[r]))
            if len(at):
                score = np.clip(x[at] @ q[r], -TOP, TOP).astype(np.int64)
                self.best.add(np.full(len(at), r), score, block.ids[at])

    def _bounded(self, rows: np.ndarray, block: Vectors) -> None:
        dims = min(self.x.shape[1], len(block.cells))  # the others are zero on one side
        q_rest, x_rest = self.rest[:, rows], block.rest
        peak = q_rest[0].max() * x_rest[0].max()
        kind = np.float32 if peak < 2**23 else np.float64 if peak < 2**51 else np.int64  # all exact
        q, x = self.x[rows, :dims].astype(kind), block.cells[:dims].astype(kind, copy=False)
        same = np.flatnonzero(np.isin(block.ids, self.ids[rows]))
        for low in range(0, len(rows), TILE[0]):
            part = slice(low, low + TILE[0])
            for left in range(0, len(block.ids), TILE[1]):
                at = slice(left, left + TILE[1])
                mine = block.ids[same[(same >= left) & (same < left + TILE[1])]]
                self._tile(rows[part], q[part], q_rest[:, part], block.ids[at], x[:, at], x_rest[:, at], mine)

    def _tile(self, rows, q, q_rest, ids, x, x_rest, mine) -> None:
        dims, k = len(x), self.k
        # what rounding can take from a bound: scores of floats are whole numbers in their exact range
        no, slack = (-np.inf, 2) if x.dtype.kind == "f" else (-(2**62), 2**12)
        floor = np.where(self.best.full(rows), self.best.scores[rows, -1], no).astype(x.dtype)
        self.tiles += 1
        d = min(dims, self.reach if self.tiles % 16 else DIM_BLOCK)
        score = q[:, :d] @ x[:d]
        for i in mine:  # a query is no candidate of itself
            score[np.ix_(self.ids[rows] == i, ids == i)] = no
        step = DIM_BLOCK
        while d < dims:
            b = d // DIM_BLOCK
            more_q, more_x = q_rest[b] * (1 + 1e-5), x_rest[b]
            live = score.max(axis=1) + more_q * more_x.max() + slack >= floor
            kept = live.sum()
            if not kept:
                self.reach = DIM_BLOCK
                return None
            if kept < 0.75 * len(live):
                rows, q, score, floor, q_rest, more_q = rows[live], q[live], score[live], floor[live], q_rest[:, live], more_q[live]
                step, self.reach = DIM_BLOCK, DIM_BLOCK
            else:
                step = min(2 * step, dims - d)
                self.reach = min(2 * d, dims)
            if dims - d >= 2 * DIM_BLOCK:
                some = slice(None, None, max(1, len(rows) // 8))
                bound = lambda s: score[s] + np.outer(more_q[s], more_x).astype(x_rest.dtype if slack > 2 else np.float32) + slack >= floor[s, None]  # noqa: E731, B023
                if bound(some).mean() * FEW < 1:
                    return self._pairs(rows, q, q_rest, ids, x, x_rest, score, floor, slack, d, *places(bound(slice(None))))
                live = score.max(axis=0) + more_x * more_q.max() + slack >= floor.min()
                if live.sum() < 0.75 * len(live):
                    ids, x, score, x_rest = ids[live], x[:, live], score[:, live], x_rest[:, live]
            score += q[:, d : d + step] @ x[d : d + step]
            d += step
        if not self.best.full(rows).all() and score.shape[1] > k:
            floor = np.maximum(floor, np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k])
        live = np.flatnonzero(score.max(axis=1) >= floor)
        r, c = places(score[live] >= floor[live, None])
        self._merge_of(rows, live[r], score[live[r], c], ids[c])

    def _pairs(self, rows, q, q_rest, ids, x, x_rest, score, floor, slack, d, r, c) -> None:
        score = score[r, c]
        while d < len(x) and len(r):
            score = score + np.einsum("ij,ji->i", q[r, d : d + DIM_BLOCK], x[d : d + DIM_BLOCK, c])
            d += DIM_BLOCK
            if d < len(x):
                b = d // DIM_BLOCK
                live = score + q_rest[b, r] * x_rest[b, c] * (1 + 1e-5) + slack >= floor[r]
                r, c, score = r[live], c[live], score[live]
        live = score >= floor[r]
        self._merge_of(rows, r[live], score[live], ids[c[live]])

    def _merge_of(self, rows, r, score, ids) -> None:
        r = rows[r]
        other = ids != self.ids[r]
        self.best.add(r[other], score[other].astype(np.int64), ids[other])

    def result(self) -> list[np.ndarray]:
        key, score, ids = self.best.flat()
        return [self.ids[key], ids, score]


def top_k(
    vectors: DataFrame, asked, *, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", slots: int | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of every row for which ``asked(id column)`` holds."""
    rows = sound(vectors, vec_id, embedding)
    queries = rows.where(asked(F.col("vec_id"))).groupBy("vec_id").agg(F.min("v").alias("v"))
    lists = meet(
        queries.withColumn("marks", F.array().cast("array<long>")), rows, lambda b: Search(b, k), "query_id long, vec_id long, score long",
        query_block=QUERY_BLOCK, held_block=CANDIDATE_BLOCK, slots=slots or slots_of(vectors, embedding), ready=ready,
    )
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lists.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
