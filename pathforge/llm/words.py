"""Vectorised words, word hashes and window hashes over Arrow text columns.

A word is a longest run of bytes other than U+0020 and U+0009..U+000D, which is the
pattern ``[^\\x20\\x09-\\x0D]+`` on UTF-8.  Null texts have no words.  All arrays are
numpy; byte-level temporaries are bounded by ``SEGMENT`` whatever a text's length.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20  # bytes hashed at once
CHUNK = 4 << 20  # bytes of text handled at once

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

U = np.uint64
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply, bijective)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U)
    out[0] = 1
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        out[filled : filled + step] = out[:step] * U(pow(base, filled, 1 << 64))
        filled += step
    return out


class Lane:
    """One polynomial hash of byte strings modulo 2**64, finalised by ``mix64``."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 64, 256, dtype=U, endpoint=False)
        self.base = (int(rng.integers(1 << 62)) << 1 | 1) & _MASK
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.empty(0, U)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, SEGMENT + 1024)
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)

    def hash(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of data[starts:ends]; the spans ascend and do not overlap."""
        out = np.empty(len(starts), U)
        i = 0
        while i < len(starts):
            lo = int(starts[i])
            k = max(i + 1, int(np.searchsorted(ends, lo + SEGMENT, "right")))
            hi = int(ends[k - 1])
            self._grow(hi - lo + 1)
            total = np.empty(hi - lo + 1, U)
            total[0] = 0
            np.cumsum(self.table[data[lo:hi]] * self.up[: hi - lo], out=total[1:])
            s = starts[i:k] - lo
            out[i:k] = (total[ends[i:k] - lo] - total[s]) * self.down[s]
            i = k
        # the length keeps strings apart that differ in trailing symbols of hash 0
        return mix64(out + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15))


LANES = (Lane(20240611), Lane(77003))


@dataclass
class Words:
    """Words of a run of texts: text d has words at[d] up to at[d + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray

    def hashes(self, lane: int = 0) -> np.ndarray:
        return LANES[lane].hash(self.data, self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.counts())


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of a string column as one byte array and int64 offsets; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = ~_SPACE[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    begin[first] = inside[first]
    end[last] = inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Return freed memory to the system, which a worker would hold while it waits for a task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_LIBC, "malloc_trim", None):
        trim(0)


def batchwise(work: Callable[[pa.RecordBatch], pa.RecordBatch], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``work`` makes of each batch; freed memory goes back to the system after each."""
    for batch in batches:
        yield work(batch)
        give_back()


def chunks(column, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes."""
    data, offsets = text_bytes(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def windows(hashes: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every window of ``size`` words that lies in one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, U)
    whole = np.ones(len(hashes), bool)
    for d in range(1, size):  # the last size-1 words of each text begin no window
        tail = at[1:] - d
        whole[tail[(tail >= at[:-1])]] = False
    where = np.flatnonzero(whole[:n])
    value = np.zeros(n, U)
    for i in range(size):
        value = value * U(0xD6E8FEB86659FD93) + hashes[i : i + n]
    return where, mix64(value[where])
