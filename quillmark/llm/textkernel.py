"""Vectorised word hashing over Arrow string columns (numpy, no per-word Python).

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. Every routine works on whole texts, in slices of about
CHUNK bytes that hold at least one document, so that temporary arrays stay small however large an Arrow batch is.
All hashes are 64-bit, seeded by constants, and so equal on every executor and on every retry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD_BASE = 0x9E3779B97F4A7C15
_SEQ_BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (xor-shift and multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_WORD_BASE))
_BYTE[_SPACE] = 0


class _Powers:
    """Powers of an odd base modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.table = base % 2**64, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            step = _U(pow(self.base, len(self.table), 2**64))
            self.table = np.concatenate([self.table, self.table * step])
        return self.table[:n]


_WORD_POW = _Powers(_WORD_BASE)
_SEQ_POW = _Powers(_SEQ_BASE)
_SEQ_INV = _Powers(pow(_SEQ_BASE, -1, 2**64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, off, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, chunk: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about chunk bytes each, at least one document."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + chunk, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


class Words:
    """Words of consecutive documents: starts and ends in bytes, hash, and first[i]:first[i + 1] those of document i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = data = _LOWER[data] if lower else data
        n = len(data)
        docs = len(offsets) - 1
        if n == 0:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.hash, self.first = np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
            return
        black = ~_SPACE[data]
        begins = offsets[:-1]
        begins = begins[begins < n]
        start = black.copy()
        start[1:] &= ~black[:-1]
        start[begins] = black[begins]
        end = black.copy()
        end[:-1] &= ~black[1:]
        inner = begins[begins > 0] - 1
        end[inner] = black[inner]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        if len(self.starts) == 0:
            self.hash = np.zeros(0, np.uint64)
            return
        head = int(self.starts[0])
        runs = np.diff(self.starts, append=n)
        place = np.arange(head, n, dtype=np.int64) - np.repeat(self.starts, runs)
        value = _BYTE[data[head:]] * _WORD_POW.upto(int(runs.max()))[place]
        self.hash = mix(np.add.reduceat(value, self.starts - head))

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, size: int) -> np.ndarray:
        """Rabin-Karp hash of the window of that many words from each word on; meaningless where the document ends."""
        n = len(self.hash)
        if n < size:
            return np.zeros(0, np.uint64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * _SEQ_POW.upto(n), out=total[1:])
        return mix((total[size:] - total[:-size]) * _SEQ_INV.upto(n - size + 1))


def chunks(column: pa.Array, lower: bool = False, chunk: int = CHUNK) -> Iterator[tuple[int, Words]]:
    """(index of the first document, its Words) for slices of a column."""
    data, offsets = buffers(column)
    for a, b in slices(offsets, chunk):
        yield a, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
