"""Token counts by a linear longest-match automaton (operator 7).

The vocabulary becomes a trie over bytes and an end-of-word symbol. Where greedy longest match would stop at a node, its
failure link names the node of what is still unmatched, and its pop count says how many tokens were emitted on the way,
both precomputed; so a word is counted in one pass over its symbols without building pieces. The distinct words of a
block of texts run through the automaton side by side, a symbol at a time (words of more than ``LONG`` bytes singly), and each
text sums its words' counts.

Words are runs outside space, tab, LF, VT, FF and CR, with A-Z lower-cased. A word that greedy longest match cannot
cover counts as one unknown token.

Defined cases: null and empty texts count nothing; other columns are kept; repeated rows count alike; an empty table gives
an empty one.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fleetpulse.llm.bpe import byte_alphabet
from fleetpulse.llm.common import LOWER, row_blocks, utf8, word_hashes, words

END = 256
SYMBOLS = 257
NONE = -1
#: Words of more bytes than this are counted one at a time, a dictionary step per byte.
LONG = 256


def read_vocabulary(path: str, suffix: str = "</w>") -> list[tuple[bytes, bool]]:
    """(bytes, ends a word) of every token of a byte-level description whose word ends carry ``suffix``."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    special = {t["content"] for t in held.get("added_tokens", [])}
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    out = []
    for token in held["model"]["vocab"]:
        body = token.removesuffix(suffix)
        if token not in special and body and all(c in byte_of for c in body):
            out.append((bytes(byte_of[c] for c in body), token != body))
    return out


class Automaton:
    """Trie edges (sorted keys node * SYMBOLS + symbol), failure links and pop counts."""

    def __init__(self, vocabulary: list[tuple[bytes, bool]]):
        children: list[dict[int, int]] = [{}]
        token_at: list[bool] = [False]
        for body, ends in vocabulary:
            node = 0
            for symbol in (*body, END) if ends else body:
                if symbol not in children[node]:
                    children[node][symbol] = len(children)
                    children.append({})
                    token_at.append(False)
                node = children[node][symbol]
            token_at[node] = True
        n = len(children)
        fail, pops = [NONE] * n, [0] * n
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for symbol, v in children[u].items():
                if token_at[v]:
                    fail[v], pops[v] = 0, 1
                else:
                    z, count = fail[u], pops[u]
                    while z != NONE and symbol not in children[z]:
                        count, z = count + pops[z], fail[z]
                    if z != NONE:
                        fail[v], pops[v] = children[z][symbol], count
                queue.append(v)
        edges = sorted((u * SYMBOLS + s, v) for u in range(n) for s, v in children[u].items())
        self.keys = np.array([k for k, _ in edges], np.int64)
        self.to = np.array([v for _, v in edges], np.int64)
        self.fail, self.pops = np.array(fail, np.int64), np.array(pops, np.int64)
        self.edges, self.fails, self.popped = dict(edges), fail, pops

    def _step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = node * SYMBOLS + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], NONE)

    def _advance(self, node: np.ndarray, count: np.ndarray, symbol: np.ndarray) -> None:
        """Take one symbol each, popping tokens along failure links; a node of NONE marks a word without cover."""
        todo = np.flatnonzero(node != NONE)
        while len(todo):
            nxt = self._step(node[todo], symbol[todo])
            good = nxt != NONE
            node[todo[good]] = nxt[good]
            todo = todo[~good]
            count[todo] += self.pops[node[todo]]
            node[todo] = self.fail[node[todo]]
            todo = todo[node[todo] != NONE]

    def count_one(self, word: bytes) -> int:
        """Tokens of one word."""
        node, count, edges = 0, 0, self.edges
        for symbol in itertools.chain(word, (END,)):
            nxt = edges.get(node * SYMBOLS + symbol)
            while nxt is None:
                count, node = count + self.popped[node], self.fails[node]
                if node == NONE:
                    return 1
                nxt = edges.get(node * SYMBOLS + symbol)
            node = nxt
        while node > 0:
            count, node = count + self.popped[node], self.fails[node]
        return count if node == 0 else 1

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of every word (byte spans, none empty)."""
        n = len(start)
        node, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if not n or not len(self.keys):
            return np.ones(n, np.int64)
        size = end - start
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        long = int(np.searchsorted(-size, -LONG, "left"))
        singly = [self.count_one(data[a : a + k].tobytes()) for a, k in zip(start[:long].tolist(), size[:long].tolist())]
        start, size, node, count = start[long:], size[long:], node[long:], count[long:]
        for d in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -d, "left"))  # words longer than d lead
            self._advance(node[:live], count[:live], data[start[:live] + d].astype(np.int64))
        self._advance(node, count, np.full(len(node), END, np.int64))
        while True:  # pop what is left; the word is covered if that ends at the root
            left = np.flatnonzero((node != NONE) & (node != 0))
            if not len(left):
                break
            count[left] += self.pops[node[left]]
            node[left] = self.fail[node[left]]
        out = np.empty(n, np.int64)
        out[order] = np.concatenate((np.array(singly, np.int64), np.where(node == NONE, 1, count)))
        return out


_automata: dict[str, Automaton] = {}


def automaton(vocabulary: tuple[tuple[bytes, bool], ...]) -> Automaton:
    """The worker's automaton of a vocabulary, built once."""
    key = hashlib.sha256(repr(vocabulary).encode()).hexdigest()
    if key not in _automata:
        _automata.clear()
        _automata[key] = Automaton(list(vocabulary))
    return _automata[key]


def count_tokens(
    docs: DataFrame, vocabulary: list[tuple[bytes, bool]], *, text: str = "text", tokens: str = "n_tokens", n_words: str = "n_words"
) -> DataFrame:
    """Every row with its numbers of tokens and words; the text itself is dropped."""
    rest = [c for c in docs.columns if c not in (text, tokens, n_words)]
    added = [T.StructField(c, T.LongType(), False) for c in (tokens, n_words)]
    schema = T.StructType([*(docs.schema[c] for c in rest), *added])
    held = tuple(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(held)
        for batch in batches:
            data, off = utf8(batch.column(len(rest)))
            found, sizes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, j in row_blocks(off):
                own = LOWER[data[off[i] : off[j]]]
                start, end, first = words(own, off[i : j + 1] - off[i])
                _, one, which = np.unique(word_hashes(own, start, end), return_index=True, return_inverse=True)
                total = np.concatenate(([0], np.cumsum(auto.counts(own, start[one], end[one])[which])))
                found.append(total[first[1:]] - total[first[:-1]])
                sizes.append(np.diff(first))
            cols = [pa.array(np.concatenate(x), pa.int64()) for x in (found, sizes)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *cols], names=schema.names)

    return docs.select(*rest, text).mapInArrow(run, schema)
