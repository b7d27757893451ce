"""Vectorised word scan: the words of many texts, as 64-bit hashes, in a few passes over their bytes.

A word is a longest run of ASCII digits, ASCII letters (A-Z count as a-z) and characters from U+0080 on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_codes = np.arange(256)
LOWER = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)
IN_WORD = ((LOWER >= 97) & (LOWER <= 122)) | ((_codes >= 48) & (_codes <= 57)) | (_codes >= 128)
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
#: Values that are hashed at a time.
PIECE = 1 << 18
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    if len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows, from 0) and the UTF-8 bytes of a text column; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return offsets - offsets[0], np.zeros(0, np.uint8)
    return offsets - offsets[0], np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]


def spans(offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs in which ``inside`` holds; no run crosses a text's border."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    borders = offsets[(offsets > 0) & (offsets < n)]
    before[borders] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[borders - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def scan(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(first, hashes): the words of row i are hashes[first[i]:first[i + 1]]."""
    offsets, data = text_bytes(column)
    starts, ends = spans(offsets, IN_WORD[data])
    first = np.searchsorted(starts, offsets)
    return first, hashes(data, starts, ends)


def characters(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, code points) of texts that are given as UTF-8 bytes."""
    if not (data >= 0x80).any():
        return offsets, data.astype(np.uint32)
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    points = data[at].astype(np.uint32)
    many = np.flatnonzero(points >= 0x80)
    padded = np.append(data, np.zeros(3, np.uint8))
    b = [padded[at[many] + k].astype(np.uint32) for k in range(4)]
    low = [x & 0x3F for x in b]
    two, three = (b[0] & 0x1F) << 6 | low[1], (b[0] & 0x0F) << 12 | low[1] << 6 | low[2]
    four = (b[0] & 0x07) << 18 | low[1] << 12 | low[2] << 6 | low[3]
    points[many] = np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, four))
    return np.searchsorted(at, offsets), points


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes, ASCII letters as small ones."""
    return run_hashes(LOWER[data], starts, ends)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of values; neither starts nor ends decrease.  Runs are taken PIECE values at a time, so a long text needs
    no more memory than a short one; a hash doesn't depend on where its run stands."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + PIECE, "right")))
        size, s, e = int(ends[j - 1]) - a, starts[i:j] - a, ends[i:j] - a
        up, down = powers(size + 1)
        x = values[a : a + size].astype(np.uint64)
        x += np.uint64(1)
        x *= up[:-1]
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(x, out=sums[1:])
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out
