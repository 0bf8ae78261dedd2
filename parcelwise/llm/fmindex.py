"""A compressed full-text index over word sequences: suffix order, wavelet matrix, backward search.

The index of one shard holds the Burrows-Wheeler transform of its sequences in a wavelet matrix of packed
bits with running counts. A pattern is looked up from its last word to its first; each step narrows
the range of suffixes that begin with what was read so far.
"""

from __future__ import annotations

import numpy as np


def suffix_array(rank: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a sequence of ranks, by doubling the compared length."""
    n = len(rank)
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[:-step] = rank[step:] + 1
        key = rank * np.int64(n + 2) + ahead
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = new
        step *= 2
        if rank[order[-1]] == n - 1 or step >= n:
            return order


class Bits:
    """A bit array with the number of ones before any place."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        whole = np.zeros(-(-len(packed) // 8) * 8 + 8, np.uint8)
        whole[: len(packed)] = packed
        self.words = whole.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)


class Index:
    """Over sequences of words numbered from 1, given one after the other with a 0 behind each."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.symbols = symbols
        n = len(symbols)
        ends = np.flatnonzero(symbols == 0)
        rank = symbols + len(ends)
        rank[ends] = np.arange(len(ends))
        self.suffixes = suffix_array(rank).astype(np.int32)
        last = symbols[self.suffixes - 1]
        self.levels = max(1, int(symbols.max(initial=1)).bit_length())
        self.bits, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bit = (last >> level) & 1
            self.bits.append(Bits(bit.astype(np.uint8)))
            self.zeros.append(int(n - bit.sum()))
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        counts = np.bincount(symbols, minlength=2)
        self.first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.base = self._descend(np.zeros(len(counts), np.int64), np.arange(len(counts)))

    def _descend(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for level, bits, zeros in zip(reversed(range(self.levels)), self.bits, self.zeros, strict=True):
            ones = bits.ones(at)
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of suffixes after putting ``symbol`` in front."""
        both = self._descend(np.concatenate([low, high]), np.concatenate([symbol, symbol]))
        shift = self.first[symbol] - self.base[symbol]
        return both[: len(low)] + shift, both[len(low) :] + shift

    def repeated(self, start: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
        """For every place of the sequence whether the ``window`` words from there occur elsewhere too.

        ``start`` and ``size`` name the sequences to stream. All are read side by side: a window is searched
        from its end; a search that fails rules out every window over the words it read, so the next one
        begins behind them; one that succeeds is carried on to the right along the other occurrence.
        """
        found = np.zeros(len(self.symbols) + 1, bool)
        stop = start + size
        end = start + window - 1
        live = np.flatnonzero(end < stop)
        at = end.copy()
        low, high = np.zeros(len(start), np.int64), np.full(len(start), len(self.symbols), np.int64)
        other = np.full(len(start), -1, np.int64)  # place of the window's other occurrence while carried on
        while len(live):
            carried = other[live] >= 0
            go = live[carried]
            if len(go):
                other[go] += 1
                end[go] += 1
                here = end[go]
                same = (here < stop[go]) & (self.symbols[here] == self.symbols[np.minimum(other[go] + window - 1, len(self.symbols) - 1)])
                same &= self.symbols[here] > 0
                found[here[same] - window + 1] = True
                lost = go[~same]
                other[lost] = -1
                at[lost], low[lost], high[lost] = end[lost], 0, len(self.symbols)
            go = live[~carried]
            if len(go):
                lo, hi = self.extend(low[go], high[go], self.symbols[at[go]])
                good = hi - lo >= 2
                on = go[good]
                low[on], high[on] = lo[good], hi[good]
                at[on] -= 1
                whole = on[end[on] - at[on] == window]
                if len(whole):
                    mine = end[whole] - window + 1
                    found[mine] = True
                    a, b = self.suffixes[low[whole]], self.suffixes[low[whole] + 1]
                    other[whole] = np.where(a == mine, b, a)
                off = go[~good]
                end[off] = at[off] + window
                at[off], low[off], high[off] = end[off], 0, len(self.symbols)
            live = live[end[live] < stop[live]]
        return found[:-1]
