"""Encoding of texts with a public byte-level BPE vocabulary.

Method: length-bucketed padded numpy matrices. Texts are split by the vocabulary's pattern; the distinct pieces of a batch
fall into buckets by their length in bytes, each a matrix of one row a piece, padded with -1. In each round every row
merges its leftmost pair of minimum rank; pairs are looked up in an open-addressing hash table of numpy arrays, rows
are compacted by shifting behind the merge, and rows without a known pair leave. Pieces beyond ``LONG`` bytes (runs
without a break) would take a round of a wide matrix for each of their merges: they are merged one by one with a heap, in
the same order.

Defined results: null and empty texts give an empty list; texts of any length are encoded whole; the strings of special tokens are
ordinary text. The vocabulary is read from the path given as a parameter on each worker.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
LONG = 128
KEPT_PIECES = 300_000

# The pattern that splits texts for this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabulary:
    """Ids of the bytes, and of pairs their rank and their merged id."""

    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        ids = model["vocab"]
        # Byte-level vocabularies write a byte as a printable character: itself where it is printable, else one from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.byte_ids = np.array([ids[char[b]] for b in range(256)], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
        self.bits = max(4, int(len(keys) * 2.5).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        self.merged = np.full(1 << self.bits, -1, np.int32)
        self.pairs = {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in enumerate(merges)}
        at, todo = self._slot(keys), np.arange(len(keys))
        out = np.array([ids[a + b] for a, b in merges], np.int32)
        while todo.size:  # of the keys that want a free slot the first gets it, the others step on
            free = self.keys[at[todo]] < 0
            slots, first = np.unique(at[todo[free]], return_index=True)
            won = todo[free][first]
            self.keys[slots], self.ranks[slots], self.merged[slots] = keys[won], won, out[won]
            todo = np.setdiff1d(todo, won)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of pairs; the rank is NONE for unknown pairs and where either is padding."""
        shape = a.shape
        key = (a.astype(np.int64) << 32 | (b.astype(np.int64) & 0xFFFFFFFF)).ravel()
        key[(a.ravel() < 0) | (b.ravel() < 0)] = -2
        at = self._slot(key)
        here = self.keys[at]
        todo = np.flatnonzero((here != key) & (here != -1) & (key >= 0))
        while todo.size:
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            here = self.keys[at[todo]]
            todo = todo[(here != key[todo]) & (here != -1)]
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE).reshape(shape), np.where(hit, self.merged[at], -1).reshape(shape)


NONE = np.iinfo(np.int32).max


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_rows(v: Vocabulary, pieces: list[bytes]) -> list[np.ndarray]:
    """Ids of pieces of similar length: one matrix, one merge a row and round."""
    n, width = len(pieces), max(map(len, pieces))
    length = np.array([len(p) for p in pieces])
    m = np.full((n, width), -1, np.int32)
    m[np.arange(width)[None, :] < length[:, None]] = v.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    rank, to = v.find(m[:, :-1], m[:, 1:])
    rows = np.arange(n)
    out: list[np.ndarray] = [None] * n  # type: ignore[list-item]
    while True:
        at = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
        live = rank[np.arange(len(rows)), at] != NONE if rank.shape[1] else np.zeros(len(rows), bool)
        for i in np.flatnonzero(~live):
            out[rows[i]] = m[i, : length[i]].copy()
        if not live.any():
            return out
        rows, m, rank, to, at, length = rows[live], m[live], rank[live], to[live], at[live], length[live] - 1
        r = np.arange(len(rows))
        new = to[r, at]
        # Compaction: all behind the merge moves up by one.
        behind = np.arange(m.shape[1] - 1)[None, :] > at[:, None]
        m = np.where(behind, m[:, 1:], m[:, :-1])
        m[r, at] = new
        shift = behind[:, :-1]
        rank, to = np.where(shift, rank[:, 1:], rank[:, :-1]), np.where(shift, to[:, 1:], to[:, :-1])
        # Only the pairs beside the merge are new.
        for side in (-1, 0):
            j = at + side
            ok = (j >= 0) & (j < rank.shape[1])
            i, j = r[ok], j[ok]
            rank[i, j], to[i, j] = v.find(m[i, j], m[i, j + 1])


def merge_long(v: Vocabulary, piece: bytes) -> list[int]:
    """Ids of one long piece: a heap of its pairs by (rank, place) over a linked list, n log n steps for n bytes."""
    x = v.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
    n = len(x)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    get = v.pairs.get
    heap = [(*m, i, x[i], x[i + 1]) for i in range(n - 1) if (m := get((x[i], x[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, new, i, a, b = heapq.heappop(heap)
        j = nxt[i] if x[i] == a else n
        if j >= n or x[j] != b:
            continue
        x[i], x[j] = new, -1
        k = nxt[i] = nxt[j]
        if k < n:
            prv[k] = i
            if m := get((new, x[k])):
                heapq.heappush(heap, (*m, i, new, x[k]))
        h = prv[i]
        if h >= 0 and (m := get((x[h], new))):
            heapq.heappush(heap, (*m, h, x[h], new))
    return [t for t in x if t >= 0]


class Encoder:
    """Encodes batches of texts; distinct pieces are encoded once and kept up to a bound."""

    def __init__(self, path: str) -> None:
        self.v, self.split, self.known = vocabulary(path), regex.compile(PATTERN), {}

    def learn(self, pieces: set[str]) -> None:
        buckets: dict[int, list[str]] = {}
        for p in pieces:
            b = len(p.encode())
            if b > LONG:
                self.known[p] = merge_long(self.v, p.encode())
            else:
                buckets.setdefault(4 if b <= 4 else 1 << (b - 1).bit_length(), []).append(p)
        for size, ps in buckets.items():
            step = max(64, 400_000 // size)
            for i in range(0, len(ps), step):
                part = ps[i : i + step]
                for p, ids in zip(part, merge_rows(self.v, [x.encode() for x in part])):
                    self.known[p] = ids.tolist()

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split.findall(t) if t else [] for t in texts]
        new = {p for s in split for p in s if p not in self.known}
        if len(self.known) + len(new) > KEPT_PIECES:
            self.known = {}
            new = {p for s in split for p in s}
        self.learn(new)
        known = self.known
        return [[i for p in s for i in known[p]] for s in split]


def encode(df: DataFrame, doc: str, text: str, path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """Rows (``doc``, ``ids`` array<int>), one for each row of ``df``."""
    kind = df.schema[doc].dataType.simpleString()

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(path)
        for b in parts:
            for i in range(0, b.num_rows, 500):
                p = b.slice(i, 500)
                ids = e.encode(p.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[doc, "ids"])

    return df.select(F.col(doc), F.col(text)).mapInArrow(work, f"`{doc}` {kind}, ids array<int>")
