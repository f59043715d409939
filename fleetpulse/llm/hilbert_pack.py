"""Packing in space-filling-curve order (operator 3).

Every document's hashed vector (counts of hashed byte 4-grams over the whole text, unit length) is projected by fixed
random signs to four dimensions; the quantised point's Hilbert key orders the documents. A range exchange on
(key, document) spreads them over the tasks, hot keys included, and each task lays its documents' tokens end to end and
cuts the stream every ``size`` tokens. What is left at a task's end is cut into powers of two, which need no padding, so
tasks need not know of each other and a lost one can be repeated alone.

Defined cases: null text counts as empty and gives the end id alone; a null document id is kept; rows that repeat are
packed each; very long texts are cut like any other; an empty table gives no pieces; other columns are not read. With
``added`` the string of an added token ('<|endoftext|>') in a text gives that token's id, as the tokenizers library has it
by default; without, it is ordinary text (the library's ``encode_special_tokens``).
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.llm.bpe import byte_alphabet
from fleetpulse.llm.common import row_blocks, utf8

DIMS, BITS, GRAMS = 4, 15, 256
END_ID = 0

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Key along the Hilbert curve of each point (rows of ``dims`` integers below 2**bits)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):  # undo the turns of every level, coarse to fine
        bit = 1 << level
        low = bit - 1
        for d in range(dims):
            turned = (x[d] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[d] ^= swap if d else 0
    for d in range(1, dims):  # Gray code
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> level) & 1)
    return key


def _signs() -> np.ndarray:
    return np.random.default_rng(2024).choice([-1.0, 1.0], size=(GRAMS, DIMS))


def vectors(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Unit-length counts of hashed byte 4-grams, a row each (zero for texts below four bytes)."""
    out = np.zeros((len(off) - 1, GRAMS))
    if len(data) >= 4:
        d = data.astype(np.uint16)
        gram = d[:-3] * np.uint16(40503) + d[1:-2] * np.uint16(30011) + d[2:-1] * np.uint16(52711) + d[3:] * np.uint16(24793)
        gram = (gram >> np.uint16(8)).astype(np.uint8)
        for k, (a, b) in enumerate(zip(off[:-1], off[1:] - 3)):
            if b > a:
                out[k] = np.bincount(gram[a:b], minlength=GRAMS)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm == 0, 1, norm)


def with_curve_key(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Rows with the Hilbert key of their text's projected vector."""
    schema = T.StructType([*docs.schema.fields, T.StructField(key, T.LongType(), False)])
    col = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = _signs()
        for batch in batches:
            data, off = utf8(batch.column(col))
            keys = [np.empty(0, np.int64)]
            for i, j in row_blocks(off):
                flat = vectors(data[off[i] : off[j]], off[i : j + 1] - off[i]) @ signs / np.sqrt(GRAMS)
                cells = np.clip((flat + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.int64)
                keys.append(hilbert(cells, BITS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(keys))], names=schema.names)

    return docs.mapInArrow(run, schema)


def read_model(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


_encoders: dict[str, tuple[tiktoken.Encoding, dict[str, int]]] = {}


def _held(model: str, pattern: str) -> tuple[tiktoken.Encoding, dict[str, int]]:
    """The byte-level BPE of a tokenizers description (its ids are the merge ranks) and its added tokens."""
    name = hashlib.sha256((model + pattern).encode()).hexdigest()
    if name not in _encoders:
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        held = json.loads(model)
        tokens = held.get("added_tokens", [])
        if any(t.get(flag) for t in tokens for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that take in or look at their surroundings are not supported")
        special = {t["content"]: t["id"] for t in tokens}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in held["model"]["vocab"].items() if t not in special}
        _encoders.clear()
        _encoders[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), special
    return _encoders[name]


def encoder(model: str, pattern: str, added: bool = False) -> Callable[[str], list[int]]:
    """Text -> ids; with ``added``, texts are split at the added tokens (leftmost, then longest) and those give their ids."""
    bpe, special = _held(model, pattern)
    if not added or not special:
        return bpe.encode_ordinary
    split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split

    def encode(text: str) -> list[int]:
        parts = split(text)
        ids = bpe.encode_ordinary(parts[0])
        for token, rest in zip(parts[1::2], parts[2::2]):
            ids.append(special[token])
            ids += bpe.encode_ordinary(rest)
        return ids

    return encode


class _Stream:
    """Cuts documents laid end to end into sequences of one task."""

    def __init__(self, size: int, base: int):
        self.size, self.next, self.fill = size, base, 0
        self.open: list[tuple] = []
        self.rows: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            part = ids[start : start + self.size - self.fill]
            self.open.append((doc, start, part, len(ids)))
            start += len(part)
            self.fill += len(part)
            if self.fill == self.size:
                self._close(self.open)
                self.open, self.fill = [], 0

    def finish(self) -> None:
        """Cut what is left into sequences of powers of two, large to small."""
        left = self.open
        while left:
            room = 1 << (self.fill.bit_length() - 1)
            self.fill -= room
            own, rest = [], []
            for doc, start, ids, total in left:
                take = min(room, len(ids))
                if take:
                    own.append((doc, start, ids[:take], total))
                if take < len(ids):
                    rest.append((doc, start + take, ids[take:], total))
                room -= take
            self._close(own)
            left = rest

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(
    docs: DataFrame,
    model: str,
    pattern: str,
    *,
    size: int = 1024,
    doc: str = "doc_id",
    text: str = "text",
    added: bool = False,
) -> DataFrame:
    """Pieces of at most ``size`` tokens of all documents (each ended by ``END_ID``), packed along the curve.

    ``model`` is the JSON of a byte-level BPE, ``pattern`` its split pattern; ``added`` has texts' added tokens recognised.
    """
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keyed = with_curve_key(rows, "text", "curve")
    tie = F.xxhash64("text")
    ordered = (
        keyed.withColumn("tie", tie).repartitionByRange("curve", "doc_id", "tie").sortWithinPartitions("curve", "doc_id", "tie")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(model, pattern, added)
        stream = _Stream(size, TaskContext.get().partitionId() << 32)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def out() -> pa.RecordBatch:
            cols = list(zip(*stream.take())) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=names)

        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            _, off = utf8(batch.column(1))
            for i, j in row_blocks(off):
                for doc_id, t in zip(ids_of[i:j], batch.column(1).slice(i, j - i).to_pylist()):
                    stream.add(doc_id, np.array([*encode(t or ""), END_ID], np.dtype("<u4")))
                yield out()
        stream.finish()
        yield out()

    return ordered.select("doc_id", "text").mapInArrow(run, PIECES)
