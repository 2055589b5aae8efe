"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie over bytes with two roots, one for pieces that begin a word and
one for pieces that continue it. Every node has a failure link and the number of pieces
that are popped on the way along it, both computed once, breadth first. A word is read
byte by byte: where the trie has no edge, the popped count is added and the link followed.
Every step moves forward or pops, so the time is linear in the word's length, and pieces
are counted but never built. Words that cannot be covered count as one unknown piece.

Words seen by a worker are remembered up to CACHED_WORDS; the others are counted anew.

Defined cases. A null or empty text has no words and no pieces. Repeated rows are counted
each. An empty table gives an empty result. Other columns pass through, and the result
columns replace inputs of the same name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almagest.llm.common import WORD, sliced

CACHED_WORDS = 500_000
_WORDS = re.compile(WORD)
NONE = -1


class LongestMatch:
    """The automaton for pieces given as bytes: `first` begin a word, `rest` continue it."""

    def __init__(self, first: Iterable[bytes], rest: Iterable[bytes]):
        self.edges: dict[int, int] = {}  # node * 256 + byte -> node
        nodes = 2
        ends: set[int] = set()
        order: list[list[tuple[int, int, int]]] = []
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                u = root
                for depth, c in enumerate(piece):
                    v = self.edges.get(u << 8 | c)
                    if v is None:
                        v, nodes = nodes, nodes + 1
                        self.edges[u << 8 | c] = v
                        if depth == len(order):
                            order.append([])
                        order[depth].append((v, u, c))
                    u = v
                if piece:
                    ends.add(u)
        self.link = [NONE] * nodes
        self.pops = [0] * nodes
        for level in order:
            for v, u, c in level:
                if v in ends:
                    self.link[v], self.pops[v] = 1, 1
                    continue
                z, n = self.link[u], self.pops[u]
                while z != NONE and (z << 8 | c) not in self.edges:
                    n += self.pops[z]
                    z = self.link[z]
                if z != NONE:
                    self.link[v], self.pops[v] = self.edges[z << 8 | c], n

    def count(self, word: bytes) -> int:
        """Number of pieces, or 0 if the word cannot be covered."""
        edges, link, pops = self.edges, self.link, self.pops
        u = n = 0
        for c in word:
            v = edges.get(u << 8 | c)
            while v is None:
                if link[u] == NONE:
                    return 0
                n += pops[u]
                u = link[u]
                v = edges.get(u << 8 | c)
            u = v
        while u != 1:
            if link[u] == NONE:
                return 0
            n += pops[u]
            u = link[u]
        return n


def byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for the 256 bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def automaton(path: str) -> tuple[LongestMatch, dict[str, int]]:
    """Automaton of a byte-level vocabulary file and the words counted so far: one per worker.

    Pieces led by a space begin a word, all others continue it.
    """
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    alphabet = byte_alphabet()
    space = next(c for c, b in alphabet.items() if b == 0x20)
    pieces = [p for p in vocabulary if all(c in alphabet for c in p)]
    first = (bytes(alphabet[c] for c in p[1:]) for p in pieces if p[0] == space)
    rest = (bytes(alphabet[c] for c in p) for p in pieces if p[0] != space)
    return LongestMatch(first, rest), {}


def with_counts(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The frame with n_words, n_tokens (an unknown word is one) and n_unknown."""
    names = ["n_words", "n_tokens", "n_unknown"]
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])
    df = df.withColumn(text, F.col(text).cast("string"))
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, known = automaton(path)
        for batch in sliced(batches, at):
            rows = []
            for t in batch.column(at).to_pylist():
                words = _WORDS.findall(t) if t else []
                counts = list(map(known.get, words))
                if None in counts:
                    fresh: dict[str, int] = {}
                    for i, n in enumerate(counts):
                        if n is None:
                            w = words[i]
                            if w not in fresh:
                                fresh[w] = matcher.count(w.encode())
                            counts[i] = fresh[w]
                    if len(known) < CACHED_WORDS:
                        known.update(fresh)
                unknown = counts.count(0)
                rows.append((len(words), sum(counts) + unknown, unknown))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(n, T.LongType()) for n in names]]))
