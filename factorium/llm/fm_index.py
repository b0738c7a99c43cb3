"""An FM-index over whole numbers: wavelet-matrix ranks, backward search and sampled suffix positions.

Symbol 0 separates: it never matches, every separator is a symbol of its own in the order of suffixes, and
a suffix that follows one is always sampled, so that no walk to a sample crosses a separator.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Prefix doubling. The first sort compares as many symbols as a 64-bit key holds; later ones touch only suffixes that are still tied. `text` ends with a separator."""
    n = len(text)
    wide = max(1, 62 // (bits + 1))
    separators = text == 0
    key = np.zeros(n, dtype=np.int64)
    alive = np.ones(n, dtype=bool)
    for i in range(wide):
        key <<= bits
        shifted = np.zeros(n, dtype=np.int64)
        m = max(0, n - i)
        shifted[:m] = text[i:]
        shifted[~alive] = 0
        key |= shifted
        alive[:m] &= ~separators[i:]
        alive[m:] = False
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    # Suffixes that meet a separator within the key are ordered by position among equals, and so are the separators themselves.
    fresh = np.empty(n, dtype=bool)
    fresh[0] = True
    fresh[1:] = (ordered[1:] != ordered[:-1]) | ~alive[order[1:]]
    rank = np.empty(n, dtype=np.int64)
    group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[order] = group
    span = wide
    while True:
        tied = np.flatnonzero(~fresh | np.append(~fresh[1:], False))
        if not len(tied):
            return order
        at = order[tied]
        first = rank[at]
        then = rank[np.minimum(at + span, n - 1)]
        resort = np.lexsort((at, then, first))
        at, first, then = at[resort], first[resort], then[resort]
        order[tied] = at
        new = np.ones(len(tied), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (then[1:] != then[:-1])
        fresh[tied] = new
        starts = np.maximum.accumulate(np.where(new, tied, 0))
        rank[at] = starts
        span *= 2


class Wavelet:
    """Ranks of symbols in a sequence: a bit plane a level, zeros moved before ones."""

    def __init__(self, seq: np.ndarray, bits: int) -> None:
        self.bits, self.planes, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(np.uint8)
            # Ones before each block of 64, and the block's bits as a word.
            padded = np.zeros((len(bit) // 64 + 1) * 64, dtype=np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.zeros(len(words) + 1, dtype=np.int32)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self.planes.append((words, before))
            self.zeros.append(int(len(bit) - before[-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def ones(self, level: int, at: np.ndarray) -> np.ndarray:
        words, before = self.planes[level]
        block, rest = at >> 6, (at & 63).astype(np.uint64)
        return before[block] + np.bitwise_count(words[block] & ((np.uint64(1) << rest) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        start = np.zeros(len(at), dtype=np.int64)
        at = at.astype(np.int64)
        for i in range(self.bits):
            one = ((symbol >> (self.bits - 1 - i)) & 1).astype(bool)
            s, a = self.ones(i, start), self.ones(i, at)
            start = np.where(one, self.zeros[i] + s, start - s)
            at = np.where(one, self.zeros[i] + a, at - a)
        return at - start

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the places, and their ranks there."""
        at = at.astype(np.int64)
        start, symbol = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        for i in range(self.bits):
            words, _ = self.planes[i]
            one = ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            s, a = self.ones(i, start), self.ones(i, at)
            start = np.where(one, self.zeros[i] + s, start - s)
            at = np.where(one, self.zeros[i] + a, at - a)
            symbol = symbol * 2 + one
        return symbol, at - start


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int) -> None:
        """text: symbols 1..symbols, 0 for separators; a last separator is added if there is none."""
        text = np.asarray(text, dtype=np.int64)
        if not len(text) or text[-1]:
            text = np.append(text, 0)
        bits = max(1, int(symbols).bit_length())
        order = suffix_array(text, bits)
        before = text[order - 1]
        before[order == 0] = 0
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols + 1))))
        self.bwt = Wavelet(before, bits)
        sampled = (before == 0) | (order % SAMPLE == 0)
        self.sampled = np.concatenate(([0], np.cumsum(sampled)))
        self.positions = order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range [lo, hi) of each row of a matrix of symbols; 0 in a pattern never matches."""
        n, length = patterns.shape
        lo, hi = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        live = np.flatnonzero((patterns != 0).all(axis=1))
        last = patterns[live, -1]
        a, b = self.starts[last], self.starts[last + 1]
        for i in range(length - 2, -1, -1):
            on = a < b
            live, a, b = live[on], a[on], b[on]
            if not len(live):
                break
            c = patterns[live, i]
            a, b = self.starts[c] + self.bwt.rank(c, a), self.starts[c] + self.bwt.rank(c, b)
        lo[live], hi[live] = a, b
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of the rows' suffixes in the text, walked back to a sample."""
        rows = np.asarray(rows, dtype=np.int64)
        out, steps = np.empty(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        open_ = np.arange(len(rows))
        at = rows
        while len(open_):
            hit = self.sampled[at + 1] > self.sampled[at]
            out[open_[hit]] = self.positions[self.sampled[at[hit]]] + steps[open_[hit]]
            open_, at = open_[~hit], at[~hit]
            symbol, rank = self.bwt.get(at)
            at = self.starts[symbol] + rank
            steps[open_] += 1
        return out
