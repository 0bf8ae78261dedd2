"""Whole texts as byte arrays: the numpy side of the operators that run in ``mapInArrow``.

A batch of texts is cut at document borders into slices of about ``SLICE`` bytes, so that the working
arrays stay small however many rows Arrow puts into a batch; a single longer text is a slice by itself.
Words are runs of bytes other than 0x20 and 0x09-0x0D and never cross a document border.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
GAP = np.zeros(256, bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_UNSTEP = pow(_STEP, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE + 1)
        factors = np.full(size, base & _MASK, dtype=np.uint64)
        factors[0] = 1
        have = np.multiply.accumulate(factors)
        if size <= 4 * SLICE:
            _powers[base] = have
    return have[:n]


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows and the end); a null counts as empty."""
    col = pc.fill_null(texts.cast(pa.large_binary()), b"")
    n = len(col)
    if not n:
        return
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(buf: np.ndarray, off: np.ndarray, gap: np.ndarray = GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word, in text order; ``gap`` marks the bytes between words."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~gap[buf]
    border = np.zeros(n + 1, bool)
    border[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | border[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | border[1:])) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, equal for equal bytes wherever they lie."""
    n = len(buf)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[buf] * powers(_STEP, n), out=sums[1:])
    return mix((sums[end] - sums[start]) * powers(_UNSTEP, n + 1)[start] + (end - start).astype(np.uint64))


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Sum of the weights (or count) by row."""
    return np.bincount(rows, weights, minlength=n)[:n]


def utf8_letters(buf: np.ndarray) -> np.ndarray:
    """1 where a code point begins."""
    return (buf & 0xC0) != 0x80
