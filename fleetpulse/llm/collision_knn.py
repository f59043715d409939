"""Approximate nearest neighbours by collision counting (operator 11).

Every vector is projected on ``PROJECTIONS`` random lines, and a block's index is one sorted array per line. A query puts
a window around its own value in every array; a vector that lies within distance R of the query falls into the window of
half width WIDTH * R with a known probability, whatever the data. Rows that collide in at least ``NEEDED`` windows are
verified by their exact distance. Virtual rehashing widens the windows, counting only what is new, until the k-th best
verified distance is no larger than R: a true neighbour is then missed with probability ``MISSED`` at most (by the
binomial law of its count), so that is one minus the expected recall.

Nothing is capped: a row that collides often enough is always verified. Each task holds the candidates of a slot
(``vector_blocks.meet``) and carries its queries' best k from block to block. Windows are widened over the first ``FIRST``
rows; from then on the k-th best distance is known, and one window of that radius is enough. Its collisions are counted on
ranks: ``BUCKETS`` equal parts of every sorted array, so that a row has a byte per line, and a window goes out to the ends
of its parts, which adds collisions and takes none. What collides often enough and is not excluded by inner products,
within their rounding, is verified. The tasks' lists of k are merged.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without
id; shorter vectors count as zero in the missing dimensions; rows with the query's own id are no candidates of it; a
repeated query id is asked once, by its smallest vector; repeated rows of other ids count each; ties go to the smaller
id; up to ``ALL`` candidates of a block are verified outright, so small tables are searched exactly and fewer candidates
than k all come back; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.vector_blocks import Block, best, meet, padded, slots_of, sound

PROJECTIONS = 128
WIDTH = 1.2
MISSED = 0.01
SEED = 20
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 16384
ALL = 64
#: Rows of a block whose distances give the first radius; it decides only how often the windows widen.
GUESS = 32
#: Rows of a slot over which windows are widened, and parts of a sorted array.
FIRST = 1024
BUCKETS = 256
#: Rows and queries whose collisions or inner products are computed at once.
ROWS, ASKED = 4096, 64


def needed(lines: int = PROJECTIONS, width: float = WIDTH, missed: float = MISSED) -> int:
    """Most collisions that a vector at the window's radius falls short of with probability ``missed`` at most."""
    p = math.erf(width / math.sqrt(2))
    below = 0.0
    for count in range(lines + 1):
        below += math.comb(lines, count) * p**count * (1 - p) ** (lines - count)
        if below > missed:
            return count
    return lines


NEEDED = needed()


def lines(dims: int) -> np.ndarray:
    """Directions, a row per dimension; wider vectors share the rows of narrower ones."""
    return np.random.default_rng(SEED).standard_normal((dims, PROJECTIONS))


class Index:
    """One sorted array of projections per line, with the rows in that order."""

    def __init__(self, cells: np.ndarray):
        values = (cells @ lines(cells.shape[1])).T
        self.rows = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(values, self.rows, axis=1)

    def places(self, targets: np.ndarray, after: bool) -> np.ndarray:
        """Per line, how many values are below the target (``after``: or equal), by bisection on all lines at once."""
        size = self.values.shape[1]
        line = np.arange(len(targets))
        low, high = np.zeros(len(targets), np.int64), np.full(len(targets), size)
        for _ in range(size.bit_length()):
            mid = (low + high) // 2
            at = self.values[line, np.minimum(mid, size - 1)]
            up = ((at <= targets) if after else (at < targets)) & (mid < high)
            low, high = np.where(up, mid + 1, low), np.where(up, high, mid)
        return low

    def between(self, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
        return [self.rows[j, a:b] for j, (a, b) in enumerate(zip(low.tolist(), high.tolist())) if a < b]


class Part(NamedTuple):
    """Candidates with their squared norms and, beyond the first rows of a slot, their parts of every line's sorted array
    (``codes``, a row per line) and the values between these parts."""

    ids: np.ndarray
    cells: np.ndarray
    square: np.ndarray
    codes: np.ndarray | None
    edges: np.ndarray | None


def ready(blocks: list[Block]) -> list[Part]:
    made = []
    with np.errstate(over="ignore", invalid="ignore"):
        for n, block in enumerate(blocks):
            cut = FIRST if n == 0 else 0
            for part in (slice(0, cut), slice(cut, None)):
                ids, cells = block.ids[part], block.cells[part]
                if not len(ids):
                    continue
                square, codes, edges = np.square(cells.astype(np.float64)).sum(axis=1), None, None
                if part.stop is None:
                    values = (cells.astype(np.float64) @ lines(cells.shape[1])).T
                    if np.isfinite(values).all():
                        edges = np.sort(values, axis=1)[:, np.arange(1, BUCKETS) * len(ids) // BUCKETS]
                        codes = np.stack([np.searchsorted(e, v, "right") for e, v in zip(edges, values)]).astype(np.uint8)
                made.append(Part(ids, cells, square, codes, edges))
    return made


class Search:
    """Best k of a block of queries over the candidates added."""

    def __init__(self, queries: Block, k: int):
        self.k, self.ids, self.cells = k, queries.ids, queries.cells.astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            self.heights = self.cells @ lines(self.cells.shape[1])
            self.square = np.square(self.cells).sum(axis=1)
        self.held = [(np.empty(0), np.empty(0, np.int64)) for _ in queries.ids]

    def add(self, part: Part) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            asked, cells = padded(self.cells, part.cells)
            bound = np.array([d[-1] if len(d) >= self.k else np.inf for d, _ in self.held])
            known = np.isfinite(WIDTH * bound) & np.isfinite(self.heights).all(axis=1) & (part.codes is not None)
            if known.any():
                rows = np.flatnonzero(known)
                for low in range(0, len(rows), ASKED):
                    self._count(rows[low : low + ASKED], bound, asked, cells, part)
            if not known.all():
                cells = cells.astype(np.float64)
                index = Index(cells)
                for r in np.flatnonzero(~known).tolist():
                    self._ask(r, asked[r], self.heights[r], index, part.ids, cells, part.ids != self.ids[r])

    def _count(self, rows: np.ndarray, bound: np.ndarray, asked: np.ndarray, cells: np.ndarray, part: Part) -> None:
        """Rows that collide with the queries in windows of their k-th best distances."""
        reach, height = (WIDTH * bound[rows] * (1 + 1e-9))[:, None], self.heights[rows]
        ends = [np.stack([np.searchsorted(e, v, "right") for e, v in zip(part.edges, x.T)]) for x in (height - reach, height + reach)]
        low, wide = ends[0].astype(np.uint8), (ends[1] - ends[0]).astype(np.uint8)
        square = np.concatenate((self.square[rows], part.square))
        some = square[square > 0]
        near = cells.dtype == np.float32 and some.min(initial=1) > 1e-20 and some.max(initial=1) < 1e30
        kind, error = (np.float32, 2.0**-22) if near else (np.float64, 2.0**-50)
        inner = asked[rows].astype(kind) @ cells.T.astype(kind, copy=False)
        count = np.empty(len(part.ids), np.uint8)
        for n, r in enumerate(rows.tolist()):
            for left in range(0, len(count), ROWS):
                at = slice(left, left + ROWS)
                inside = part.codes[:, at] - low[:, n, None] <= wide[:, n, None]
                np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8, out=count[at])
            sums = self.square[r] + part.square
            away = sums - 2 * inner[n]
            out = (away > bound[r] ** 2 * (1 + 1e-9) + sums * (cells.shape[1] + 8) * error + 1e-300) & np.isfinite(away)
            found = np.flatnonzero((count >= NEEDED) & ~out & (part.ids != self.ids[r]))
            if len(found):
                self._verify(r, asked[r], found, part.ids, cells)

    def _verify(self, r: int, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, cells: np.ndarray) -> None:
        away = np.sqrt(np.square(cells[rows].astype(np.float64) - q).sum(axis=1))
        d, i = np.concatenate((self.held[r][0], away)), np.concatenate((self.held[r][1], ids[rows]))
        at = best(-d, i, self.k)
        self.held[r] = d[at], i[at]

    def _ask(self, r, q, height, index: Index, ids, cells, left) -> None:
        if left.sum() <= ALL:
            return self._verify(r, q, np.flatnonzero(left), ids, cells)
        some = cells[:: max(1, len(cells) // GUESS)]
        away = np.sqrt(np.square(some - q).sum(axis=1))
        radius = away[away > 0].min(initial=np.inf) / 2
        if not np.isfinite(radius):  # the sampled rows are copies of the query
            radius = float(np.ptp(index.values, axis=1).max()) / WIDTH
        count = np.zeros(len(cells), np.int64)
        low = high = index.places(height, False)
        step = 1.3
        while True:
            bound = self.held[r][0][-1] if len(self.held[r][0]) >= self.k else np.inf
            radius = min(radius, bound)
            reach = WIDTH * radius * (1 + 1e-9)
            if not np.isfinite(reach):  # beyond doubles: all that is left
                return self._verify(r, q, np.flatnonzero(left), ids, cells)
            wider = index.places(height - reach, False), index.places(height + reach, True)
            new = index.between(wider[0], low) + index.between(high, wider[1])
            low, high = wider
            if new:
                count += np.bincount(np.concatenate(new), minlength=len(count))
                rows = np.flatnonzero(left & (count >= NEEDED))
                if len(rows):
                    left[rows] = False
                    self._verify(r, q, rows, ids, cells)
            if len(self.held[r][0]) >= self.k and radius >= self.held[r][0][-1] or not left.any():
                return None
            radius, step = radius * step, step * 1.1
            if radius == 0:
                radius = np.inf

    def result(self) -> list[np.ndarray]:
        sizes = [len(d) for d, _ in self.held]
        return [np.repeat(self.ids, sizes), np.concatenate([i for _, i in self.held]), np.concatenate([d for d, _ in self.held])]


def nearest(
    vectors: DataFrame, asked, *, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", slots: int | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found, by Euclidean distance, of every row for which
    ``asked(id column)`` holds."""
    slots = slots or slots_of(vectors, embedding)
    rows = sound(vectors, vec_id, embedding).where(F.exists("v", lambda x: x != 0))
    queries = rows.where(asked(F.col("vec_id"))).groupBy("vec_id").agg(F.min("v").alias("v"), F.first("marks").alias("marks"))
    found = meet(
        queries, rows, lambda b: Search(b, k), "query_id long, vec_id long, score double",
        query_block=QUERY_BLOCK, held_block=CANDIDATE_BLOCK, slots=slots, ready=ready,
    )
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
