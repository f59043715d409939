"""Helpers shared by the training-data operators: table access, shipping the package to Python workers,
and vectorised UTF-8, word and shingle hashing over Arrow columns."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from fleetpulse.session import checkpoint_dir

#: Words are runs of bytes outside this class (space, tab, LF, VT, FF, CR).
WHITE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SHINGLE = 5

_shipped: set[str] = set()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package's source (once per application)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="fleetpulse-src-"), "fleetpulse_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(os.path.basename(package), os.path.relpath(full, package)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def prepare(spark: SparkSession) -> None:
    """What every operator here needs of a session: the package on the workers and the shared checkpoint folder."""
    ship_package(spark)
    checkpoint_dir(spark)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values laid end to end, n + 1 offsets); null counts as empty."""
    col = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = col.buffers()
    off = np.frombuffer(ends, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def row_blocks(off: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (a longer row stands alone)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _randoms(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = _randoms(11, 256)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_PLACE = _randoms(23, SHINGLE) | np.uint64(1)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte span of each word, and the index of each row's first word (n + 1)."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    white = _IS_WHITE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[1:], after[:-1] = white[:-1], white[1:]
    before[0] = after[-1] = True
    inner = off[(off > 0) & (off < n)]
    before[inner], after[inner - 1] = True, True
    start = np.flatnonzero(~white & before)
    end = np.flatnonzero(~white & after) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every word's bytes."""
    if len(start) == 0:
        return np.empty(0, np.uint64)
    size = end - start
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    at = place + np.repeat(start, size)
    power = np.full(int(size.max()), _STEP, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    return mix64(np.add.reduceat(_BYTE[data[at]] * power[place], first) + size.astype(np.uint64))


def shingle_sets(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its 5-word shingles over A-Z lower-cased words; a row of one to four words
    has its whole sequence as the one shingle; a row without words has none."""
    data = LOWER[data]
    start, end, first = words(data, off)
    h = word_hashes(data, start, end)
    win = np.empty(0, np.uint64)
    if len(h) >= SHINGLE:
        win = np.zeros(len(h) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            win += h[k : k + len(win)] * _PLACE[k]
        win = mix64(win)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= SHINGLE:
            s = np.sort(win[a : b - SHINGLE + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            whole = (h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix64(np.array([whole], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
