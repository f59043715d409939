"""Hard-negative mining by Strassen products of anchor-candidate tiles (operator 13).

A tile's scores are the product of anchors and candidates, both scaled to integers: Strassen's recursion halves all three
sizes, zero-padded to a multiple of two per level, down to leaves that are multiplied plainly. It works in floats where the
norms show that every sum is a whole number in their exact range, else in int64, whose sums wrap, which leaves every score
below 2**63 right. Two passes over the tiles follow, each keeping small lists that merge: the best positives of every
anchor, then, with the score windows known that the positives open, the best negatives of every (anchor, positive). A
slot's candidates are ordered by label, so that most tiles have one: anchors of other labels take no part in such a tile
in the first pass, nor anchors of that label in the second.

Defined cases: rows with a null id, label or vector or a null or non-finite component take no part; shorter vectors count
as zero in the missing dimensions; rows with the anchor's own id are neither positives nor negatives of it; a repeated
anchor id is asked once, by its smallest (label, vector); repeated rows of other ids count each; ties go to the smaller
id; a score beyond a long counts as the nearest long; an anchor without positives, or a positive without a row in its
window, gives no rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.vector_blocks import TOP, Block, Lists, grown, largest, meet, places, recut, shuffles_removed, slim, slots_of, sound, whole, whole_numbers

SCALE = 256
ANCHOR_BLOCK = 256
CANDIDATE_BLOCK = 4096
LEAF = 32
#: Candidates of a tile, whose scores stay in a core's cache.
TILE = 2048


def _levels(n: int, m: int, p: int, leaf: int = LEAF) -> int:
    levels = 0
    while min(n, m, p) >> levels > leaf:
        levels += 1
    return levels


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b for arrays of whole numbers (floats, int64 or Python integers)."""
    n, m, p = a.shape[0], a.shape[1], b.shape[1]
    levels = _levels(n, m, p, leaf)
    step = 1 << levels
    up = lambda x: x + -x % step
    a, b = grown(a, up(n), up(m)), grown(b, up(m), up(p))

    def product(x: np.ndarray, y: np.ndarray, level: int) -> np.ndarray:
        if not level:
            return x @ y
        i, j, k = x.shape[0] // 2, x.shape[1] // 2, y.shape[1] // 2
        x11, x12, x21, x22 = x[:i, :j], x[:i, j:], x[i:, :j], x[i:, j:]
        y11, y12, y21, y22 = y[:j, :k], y[:j, k:], y[j:, :k], y[j:, k:]
        m1 = product(x11 + x22, y11 + y22, level - 1)
        m2 = product(x21 + x22, y11, level - 1)
        m3 = product(x11, y12 - y22, level - 1)
        m4 = product(x22, y21 - y11, level - 1)
        m5 = product(x11 + x12, y22, level - 1)
        m6 = product(x21 - x11, y11 + y12, level - 1)
        m7 = product(x12 - x22, y21 + y22, level - 1)
        out = np.empty((2 * i, 2 * k), m1.dtype)
        out[:i, :k], out[:i, k:], out[i:, :k], out[i:, k:] = m1 + m4 - m5 + m7, m3 + m5, m2 + m4, m1 - m2 + m3 + m6
        return out

    return product(a, b, levels)[:n, :p]


class Vectors(NamedTuple):
    """Whole numbers, a row or a column per vector, the largest norm and each vector's largest component."""

    cells: np.ndarray
    norm: float
    largest: np.ndarray


def _vectors(x: np.ndarray) -> Vectors:
    with np.errstate(over="ignore"):
        return Vectors(slim(x), float(np.sqrt(np.square(x.astype(np.float64)).sum(axis=1)).max(initial=0)), largest(x))


def tile_scores(a: Vectors, b: Vectors) -> np.ndarray:
    """Inner products of the rows of a with the columns of b, within +-TOP: whole numbers, floats if these are exact."""
    limit = (2**62 / max(a.cells.shape[1], len(b.cells), 1)) ** 0.5
    big_a, big_b = a.largest >= limit, b.largest >= limit
    dims = min(a.cells.shape[1], len(b.cells))  # the others are zero on one side
    x, y = a.cells[:, :dims], b.cells[:dims]
    if not (big_a.any() or big_b.any()):
        # a level adds two vectors of either side, and four products
        peak = a.norm * b.norm * 16 ** _levels(len(x), dims, y.shape[1])
        kind = np.float32 if peak < 2**23 else np.float64 if peak < 2**51 else np.int64
        return strassen(x.astype(kind, copy=False), y.astype(kind, copy=False))
    out = np.zeros((len(x), y.shape[1]), np.int64)
    for in_a in (False, True):
        for in_b in (False, True):
            i, j = np.flatnonzero(big_a == in_a), np.flatnonzero(big_b == in_b)
            if len(i) and len(j):
                if in_a or in_b:
                    part = np.clip(strassen(whole_numbers(x[i]), whole_numbers(y[:, j])), -TOP, TOP).astype(np.int64)
                else:
                    part = strassen(x[i].astype(np.int64), y[:, j].astype(np.int64))
                out[np.ix_(i, j)] = part
    return out


class Tile(NamedTuple):
    """Candidates by id, a column each, and their one label or None."""

    ids: np.ndarray
    labels: np.ndarray
    label: int | None
    vectors: Vectors


def ready(blocks: list[Block]) -> list[Tile]:
    """The candidates of a slot by label, in tiles; their order is mixed, so that good scores come early."""
    made = []
    for ids, marks, cells in recut(blocks, lambda b: b.marks[:, 0], min(TILE, CANDIDATE_BLOCK)):
        by = np.argsort(ids, kind="stable")
        cells, norm, peaks = _vectors(whole(cells[by], SCALE))
        label = int(marks[0, 0]) if (marks[:, 0] == marks[0, 0]).all() else None
        made.append(Tile(ids[by], marks[by, 0], label, Vectors(np.ascontiguousarray(cells.T), norm, peaks)))
    return [made[n] for n in np.random.default_rng(1).permutation(len(made))]


class _Anchors:
    def __init__(self, anchors: Block, keys: int, k: int):
        self.anchors, self.ids, self.labels = anchors, anchors.ids, anchors.marks[:, 0]
        self.vectors, self.lists = _vectors(whole(anchors.cells, SCALE)), Lists(keys, k)

    def scores(self, rows: np.ndarray, tile: Tile, same: bool) -> np.ndarray:
        """Of the anchors with the tile's candidates; below all others where these do not have the ``same`` (or another)
        label or are the anchor itself."""
        own = Vectors(self.vectors.cells[rows], self.vectors.norm, self.vectors.largest[rows])
        out = tile_scores(own, tile.vectors)
        if out.dtype == np.int64:
            out = np.maximum(out, -TOP)  # leaves one value below
        none = -np.inf if out.dtype.kind == "f" else -TOP - 1
        if tile.label is None:
            out[(self.labels[rows, None] == tile.labels) != same] = none
        first, last = (np.searchsorted(tile.ids, self.ids[rows], side) for side in ("left", "right"))
        for r in np.flatnonzero(first < last).tolist():
            out[r, first[r] : last[r]] = none
        return out


class Positives(_Anchors):
    """Best rows of the anchors' own labels (first mark)."""

    def __init__(self, anchors: Block, k: int):
        super().__init__(anchors, len(anchors.ids), k)

    def add(self, tile: Tile) -> None:
        rows = np.flatnonzero(np.isin(self.labels, tile.labels) if tile.label is None else self.labels == tile.label)
        if not len(rows):
            return
        score = self.scores(rows, tile, True)
        none = -np.inf if score.dtype.kind == "f" else -TOP - 1
        full, k = self.lists.full(rows), self.lists.k
        floor = np.where(full, self.lists.scores[rows, -1], none).astype(score.dtype)
        if not full.all() and score.shape[1] > k:
            floor = np.maximum(floor, np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k])
        live = np.flatnonzero(score.max(axis=1) >= floor)
        r, c = places((score[live] >= floor[live, None]) & (score[live] > none))
        self.lists.add(rows[live[r]], score[live[r], c].astype(np.int64), tile.ids[c])

    def result(self) -> list[np.ndarray]:
        key, score, ids = self.lists.flat()
        return [self.ids[key], ids, score]


class Negatives(_Anchors):
    """Best rows of other labels in the window of each positive; marks: label, then (place, id, score) per positive."""

    def __init__(self, anchors: Block, k: int, low: int):
        self.goals = anchors.marks[:, 1:].reshape(len(anchors.ids), -1, 3)
        self.wide = self.goals.shape[1]
        super().__init__(anchors, len(anchors.ids) * self.wide, k)
        self.high = np.where(self.goals[:, :, 0] > 0, self.goals[:, :, 2], -TOP)
        self.low = np.array([[-(-low * h // 100) for h in row] for row in self.high.tolist()], dtype=object).reshape(self.high.shape)
        open_ = (self.goals[:, :, 0] > 0) & (self.low <= self.high)
        self.low = np.where(open_, self.low, TOP).astype(np.int64)
        self.high = np.where(open_, self.high, -TOP)
        self.open = open_.any(axis=1)

    def add(self, tile: Tile) -> None:
        rows = np.flatnonzero(self.open if tile.label is None else self.open & (self.labels != tile.label))
        if not len(rows):
            return
        score = self.scores(rows, tile, False)
        key = rows[:, None] * self.wide + np.arange(self.wide)
        # the windows as far as their lists are not full of better ones; beyond the tile's exact numbers they round away from it
        low = np.where(self.lists.full(key), np.maximum(self.low[rows], self.lists.scores[key, -1]), self.low[rows]).astype(score.dtype)
        high = self.high[rows].astype(score.dtype)
        floor, top = low.min(axis=1), high.max(axis=1)
        live = np.flatnonzero(score.max(axis=1) >= floor)
        r, c = places((score[live] >= floor[live, None]) & (score[live] <= top[live, None]))
        if len(r):
            r, ids, score = live[r], tile.ids[c], score[live[r], c]
            at, g = places((score[:, None] >= low[r]) & (score[:, None] <= high[r]))
            self.lists.add(key[r[at], g], score[at].astype(np.int64), ids[at])

    def result(self) -> list[np.ndarray]:
        key, score, ids = self.lists.flat()
        goal = self.goals.reshape(-1, 3)[key]
        return [self.ids[key // max(1, self.wide)], goal[:, 0], goal[:, 1], goal[:, 2], ids, score]


def mine(
    vectors: DataFrame,
    asked,
    *,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    slots: int | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every row for which
    ``asked(id column)`` holds and each of its best ``positives`` of the same label, the best ``negatives`` of another
    label whose score is ``low`` to 100 percent of the positive's."""
    slots = slots or slots_of(vectors, embedding)
    rows = sound(vectors, vec_id, embedding, F.col("label") if label is None else label)
    smallest = F.min(F.struct("marks", "v"))
    anchors = rows.where(asked(F.col("vec_id"))).groupBy("vec_id").agg(smallest.alias("s")).select("vec_id", "s.v", "s.marks")
    sizes = {"query_block": ANCHOR_BLOCK, "held_block": CANDIDATE_BLOCK, "slots": slots, "ready": ready}

    near = meet(anchors, rows, lambda b: Positives(b, positives), "vec_id long, positive_id long, score long", **sizes)
    first = Window.partitionBy("vec_id").orderBy(F.desc("score"), "positive_id")
    goals = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    # a row per anchor with exactly ``positives`` triples of longs, place 0 where there is none
    listed = F.sort_array(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), "positive_id", "score")))
    triples = F.flatten(F.transform(listed, lambda g: F.array(g["place"], g["positive_id"], g["score"])))
    filled = F.slice(F.concat(triples, F.array_repeat(F.lit(0).cast("long"), 3 * positives)), 1, 3 * positives)
    # checkpointed, so that the first pass leaves its shuffles before the second makes as large ones
    with shuffles_removed(vectors.sparkSession):
        opened = anchors.join(goals.groupBy("vec_id").agg(filled.alias("goals")), "vec_id").select("vec_id", "v", F.concat("marks", "goals").alias("marks"))
        opened = opened.checkpoint()

    found = meet(
        opened, rows, lambda b: Negatives(b, negatives, low),
        "anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long", **sizes,
    )
    by = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
