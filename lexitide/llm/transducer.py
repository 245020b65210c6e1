"""A byte transducer over UTF-8 texts: one pass of table look-ups that counts and cuts words, and a verified hash table.

The state after a byte depends on that byte alone (between words or inside one), so the whole pass is a look-up of the
next state and one of the output for (state, byte); a text starts between words. Outputs are sets of marks: a word starts
here, a word ended before here, a code point starts here, a capital, a symbol.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lexitide.llm.textarrays import flat, mix, powers

START, STOP, POINT, CAPITAL, SYMBOL = 1, 2, 4, 8, 16
BETWEEN, INSIDE = 0, 1

# White space and symbols of the audit's filters.
WHITE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#$%&*|"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """`(state after a byte, marks by [state before, byte])`."""
    byte = np.arange(256)
    inside = ~np.isin(byte, list(WHITE))
    marks = np.zeros((2, 256), np.uint8)
    marks[:, (byte & 0xC0) != 0x80] |= POINT
    marks[:, (byte >= ord("A")) & (byte <= ord("Z"))] |= CAPITAL
    marks[:, np.isin(byte, list(SYMBOLS))] |= SYMBOL
    marks[BETWEEN, inside] |= START
    marks[INSIDE, ~inside] |= STOP
    return np.where(inside, INSIDE, BETWEEN).astype(np.uint8), marks


_AFTER, _MARKS = _tables()
_VALUE = np.random.default_rng(20250111).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 2**64)


class Pass:
    """What one pass over a text column marks: per text counts, and the spans of its words."""

    def __init__(self, column: pa.Array):
        self.data, self.bounds = flat(column)
        after = _AFTER[self.data]
        before = np.concatenate([[BETWEEN], after[:-1]]).astype(np.uint8) if len(after) else after
        full = self.bounds[:-1] < self.bounds[1:]
        before[self.bounds[:-1][full]] = BETWEEN
        self.marks = _MARKS[before, self.data]
        last = self.bounds[1:][full]
        self.start = np.flatnonzero(self.marks & START)
        self.end = np.sort(np.concatenate([np.flatnonzero(self.marks & STOP), last[after[last - 1] == INSIDE]]))
        self.row = np.searchsorted(self.bounds, self.start, side="right") - 1

    def count(self, mark: int) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum((self.marks & mark) != 0)])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]

    def distinct(self) -> np.ndarray:
        """Distinct words of each text."""
        first = first_spans(self.data, self.start, self.end, self.row)
        return np.bincount(self.row[first], minlength=len(self.bounds) - 1)


def _same(data: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether spans `a` and `b`, equally long, hold the same bytes."""
    if not len(a):
        return np.zeros(0, bool)
    n = size[a]
    before = np.cumsum(n) - n
    step = np.arange(int(n.sum())) - np.repeat(before, n)
    equal = data[np.repeat(start[a], n) + step] == data[np.repeat(start[b], n) + step]
    return np.logical_and.reduceat(equal, before)


def first_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, bits: int = 64) -> np.ndarray:
    """Marks each span that is the first with its bytes in its row.

    All spans enter one open-addressing table together, a probe per round. A slot goes to the first span that claims it;
    a span that meets one of the same row with the same bytes (compared, not only hashed) is a repetition, any other
    moves on. Equal spans probe the same slots in the same rounds, so they always meet. `bits` cuts the hash, for tests.
    """
    n, size = len(start), end - start
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * powers(_BASE, len(data)), dtype=np.uint64)])
    hashes = mix((sums[end] - sums[start]) * powers(_INVERSE, len(data) + 1)[start] + row.astype(np.uint64) * np.uint64(_BASE))
    hashes &= np.uint64(2**bits - 1)
    mask = (1 << max(4, (2 * n).bit_length())) - 1
    slot = (hashes & np.uint64(mask)).astype(np.int64)
    owner = np.full(mask + 1, -1, np.int64)
    first = np.zeros(n, bool)
    left = np.arange(n)
    while len(left):
        at = slot[left]
        claims = left[owner[at] < 0][::-1]
        owner[slot[claims]] = claims
        held = owner[at]
        first[left[held == left]] = True
        alike = (held != left) & (row[held] == row[left]) & (size[held] == size[left]) & (hashes[held] == hashes[left])
        alike[alike] = _same(data, start, size, left[alike], held[alike])
        left = left[(held != left) & ~alike]
        slot[left] = (slot[left] + 1) & mask
    return first
