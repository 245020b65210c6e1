"""Words of an Arrow text column as flat numpy arrays: bounds, documents and 64-bit hashes, without a Python loop per word.

A word hash is a polynomial over the bytes with a fixed random value for each byte, modulo 2^64, finished with a
mixing step; a span hash is the same over word hashes. Both come from prefix sums, so any span costs one subtraction.
Equal words have equal hashes; n different ones collide with probability of about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C13  # 3 modulo 8, so that powers of it have full period
_INVERSE = pow(_BASE, -1, 2**64)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}

SLICE_BYTES = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    kept = _POWERS.get(base)
    if kept is None or len(kept) < n:
        kept = np.full(max(n, SLICE_BYTES), base, np.uint64)
        kept[0] = 1
        _POWERS[base] = np.multiply.accumulate(kept)
    return _POWERS[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most `limit` bytes of text each, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the bounds of its rows; a null row is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


class Words:
    """Words of a text column in order: `start`, `end` (bytes), `row` of the column, and `first`, each row's first word."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, bounds = flat(column)
        if lower:
            self.data = _LOWER[self.data]
        solid = ~_WHITE[self.data]
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        full = bounds[:-1] < bounds[1:]
        begins[bounds[:-1][full]] = solid[bounds[:-1][full]]
        ends[bounds[1:][full] - 1] = solid[bounds[1:][full] - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.row = np.searchsorted(bounds, self.start, side="right") - 1
        self.first = np.searchsorted(self.row, np.arange(len(column) + 1))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * powers(_BASE, n), out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * powers(_INVERSE, n + 1)[self.start])


class Spans:
    """Hashes of any span of a sequence of word hashes."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers(_BASE, n), out=self.sums[1:])
        self.back = powers(_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))
