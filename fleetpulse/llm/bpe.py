"""Byte-level BPE encoding and decoding (operator 1) with the tokenizers library over Arrow batches.

A rank file is turned into a ``tokenizers`` BPE model: every token's bytes are written in the byte-to-character
alphabet of byte-level BPE and its merge is the pair of lower-ranked tokens it is made of. Texts are cut at white
space into units that no match of the split pattern crosses; each distinct unit is split by the pattern and its matches
encoded by the library once per worker (bounded memory); a text's ids are its units' ids in order. A token's character
span follows from its byte length and the UTF-8 lead bytes of the text; a token that ends inside a character shares it
with the next one.

Defined cases: null text counts as empty; an empty text has no ids; special tokens are never produced, their strings
are ordinary text; rows keep their other columns; repeated rows are encoded alike; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, models

from fleetpulse.llm.common import row_blocks, utf8

#: Unicode White_Space, the class that ``\s`` names in the split patterns.
_WS = r"\t-\r \x85\xa0  -     　"
_RUN = re.compile(rf"[{_WS}]{{2}}")
_UNIT = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Text encoded at once, and the distinct units and pattern matches that a worker remembers before it starts anew.
BLOCK_BYTES = 1 << 20
CACHE_UNITS = 300_000
CACHE_PIECES = 150_000


def byte_alphabet() -> list[str]:
    """Character of each byte: printable Latin-1 bytes stand for themselves, the others for 256 and up."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens that merge into ``token``: what lower-ranked merges leave of its bytes."""
    own = ranks[token]
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], own))
        if ranks.get(parts[best] + parts[best + 1], own) >= own:
            return None
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


class Spec(NamedTuple):
    """A tokenizer to ship to the workers: the library's JSON description and the split pattern."""

    model: str
    pattern: str


def from_ranks(path: str, pattern: str) -> Spec:
    """The library's BPE model equal to a rank file."""
    ranks, alphabet = read_ranks(path), byte_alphabet()
    written = {t: "".join(alphabet[b] for b in t) for t in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1 and (pair := _halves(token, ranks)):
            merges.append((written[pair[0]], written[pair[1]]))
    model = models.BPE(vocab={written[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
    return Spec(Tokenizer(model).to_str(), pattern)


class _Units(dict):
    """Unit -> its number; a unit not met before is noted for encoding."""

    def __init__(self, lead: str, noted: list[str]):
        super().__init__()
        self.lead, self.noted = lead, noted

    def __missing__(self, part: str) -> int:
        self[part] = n = len(self.noted)
        self.noted.append(self.lead + part)
        return n


class Codec:
    """Encoder and decoder of one byte-level BPE model."""

    def __init__(self, spec: Spec):
        self.model = Tokenizer.from_str(spec.model).model
        self.split = regex.compile(spec.pattern).findall
        self.alphabet = dict(enumerate(byte_alphabet()))
        byte_of = {c: b for b, c in self.alphabet.items()}
        vocab = json.loads(spec.model)["model"]["vocab"]
        self.table = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.table[i] = bytes(byte_of[c] for c in token)
        self.names = [str(i) for i in range(len(self.table))]
        self.pieces: dict[str, list[int]] = {}
        self._forget()

    def _forget(self) -> None:
        self.noted: list[str] = []
        self.heads, self.tails, self.runs = (_Units(lead, self.noted) for lead in ("", " ", ""))
        self.pool = np.empty(0, np.uint32)
        self.first = np.zeros(1, np.int64)

    def _piece(self, piece: str) -> list[int]:
        written = piece.encode("utf-8").decode("latin-1").translate(self.alphabet)
        self.pieces[piece] = ids = [t.id for t in self.model.tokenize(written)]
        return ids

    def _learn(self) -> None:
        """Encode the units noted since the last call and lay their ids behind the others'."""
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        flat, sizes, known = [], [], self.pieces
        for unit in self.noted[len(self.first) - 1 :]:
            before = len(flat)
            for piece in self.split(unit):
                flat += known.get(piece) or self._piece(piece)
            sizes.append(len(flat) - before)
        if sizes:
            self.pool = np.concatenate((self.pool, np.array(flat, np.uint32)))
            self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(sizes)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts laid end to end, n + 1 offsets)."""
        if len(self.noted) > CACHE_UNITS:
            self._forget()
        met: list[int] = []
        ends = [0]
        for text in texts:
            if _RUN.search(text):
                met += map(self.runs.__getitem__, _UNIT.findall(text))
            else:  # every space stands alone, so a match begins at it
                parts = text.split(" ")
                met.append(self.heads[parts[0]])
                met += map(self.tails.__getitem__, parts[1:])
            ends.append(len(met))
        self._learn()
        at = np.array(met, np.int64)
        size = self.first[at + 1] - self.first[at]
        done = np.concatenate(([0], np.cumsum(size)))
        ids = self.pool[np.arange(done[-1]) + np.repeat(self.first[at] - done[:-1], size)]
        return ids, done[np.array(ends)]

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def decode(self, ids) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_pieces(self, ids) -> list[str]:
        """Text per token: a character split over tokens goes to the token that completes it."""
        inc = codecs.getincrementaldecoder("utf-8")("replace")
        out = [inc.decode(self.table[i]) for i in ids]
        if out:
            out[-1] += inc.decode(b"", True)
        return out

    def spans(self, text: str, ids) -> tuple[np.ndarray, np.ndarray]:
        """Character start and end of every token: its first byte's and its last byte's character, the latter included."""
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        end = np.cumsum([len(self.table[i]) for i in ids], dtype=np.int64)
        start = np.concatenate(([0], end[:-1])) if len(ids) else end
        return char[start], char[end - 1] + 1


_codecs: dict[str, Codec] = {}


def codec(spec: Spec) -> Codec:
    """The worker's codec of a description, built once."""
    key = hashlib.sha256("\0".join(spec).encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(spec)
    return _codecs[key]


def encode(docs: DataFrame, spec: Spec, *, text: str = "text", ids: str = "ids", spans: bool = False) -> DataFrame:
    """Every row with its token ids (and, with ``spans``, ``<ids>_start`` and ``<ids>_end`` character offsets)."""
    added = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    if spans:
        added += [T.StructField(f"{ids}_{x}", T.ArrayType(T.IntegerType(), False), False) for x in ("start", "end")]
    names = {f.name for f in added}
    kept = docs.drop(*names)
    schema = T.StructType([*kept.schema.fields, *added])
    col = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec)
        for batch in batches:
            _, off = utf8(batch.column(col))
            for i, j in row_blocks(off, BLOCK_BYTES):
                part = batch.slice(i, j - i)
                texts = [t or "" for t in part.column(col).to_pylist()]
                flat, at = c.encode(texts)
                own, laid = pa.array(at.astype(np.int32)), [flat]
                if spans:
                    both = [c.spans(t, flat[a:b]) for t, a, b in zip(texts, at[:-1], at[1:])]
                    laid += [np.concatenate([x[k] for x in both]) for k in (0, 1)]
                cols = [pa.ListArray.from_arrays(own, pa.array(x.astype(np.int32))) for x in laid]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=schema.names)

    return kept.mapInArrow(run, schema)


def digests(docs: DataFrame, spec: Spec, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, ids_sha256, and decoded_sha256 and round_trip of the bytes decoded from the ids.

    Encodes and decodes in one pass, so that no ids leave the worker.
    """
    kind = docs.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField(key, kind),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
            T.StructField("round_trip", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec)
        for batch in batches:
            data, off = utf8(batch.column(1))
            for i, j in row_blocks(off, BLOCK_BYTES):
                flat, at = c.encode([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()])
                listed, rows = flat.tolist(), []
                for k in range(j - i):
                    ids = listed[at[k] : at[k + 1]]
                    raw = c.decode_bytes(ids)
                    rows.append(
                        (
                            len(ids),
                            hashlib.sha256(",".join(map(c.names.__getitem__, ids)).encode()).hexdigest(),
                            hashlib.sha256(raw).hexdigest(),
                            raw == data[off[i + k] : off[i + k + 1]].tobytes(),
                        )
                    )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *(pa.array(x) for x in zip(*rows))], names=schema.names
                )

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
