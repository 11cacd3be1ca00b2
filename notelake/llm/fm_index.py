"""FM-index over a text of small symbols: suffix array, wavelet tree, backward search, sampled locate.

All steps work on numpy arrays, for many patterns at once. Symbols are 1..31; 0 ends the text.
"""

from __future__ import annotations

import numpy as np

SYMBOL_BITS = 5
#: Two ranks and a position of this many bits fit one sort key, so a text has fewer symbols than 2 to this power.
MOST_BITS = 20


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorted suffix starts by prefix doubling; each round sorts packed (rank, rank ahead, position) keys."""
    n = len(text)
    if n >= 1 << MOST_BITS:
        raise ValueError("the text is too long for one shard")
    at = np.arange(n, dtype=np.uint64)
    first = min(8, n)
    key = np.zeros(n, np.uint64)
    for j in range(first):
        key <<= np.uint64(SYMBOL_BITS)
        key[: n - j] |= text[j:].astype(np.uint64)
    low = np.uint64((1 << MOST_BITS) - 1)
    shift = np.uint64(MOST_BITS)
    packed = np.sort((key << shift) | at)
    reach = first
    while True:
        order = (packed & low).astype(np.int64)
        groups = packed >> shift
        new = np.empty(n, np.int64)
        new[0] = 0
        np.cumsum(groups[1:] != groups[:-1], out=new[1:])
        if new[-1] == n - 1:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = new
        ahead = np.zeros(n, np.uint64)
        ahead[: n - reach] = rank[reach:] + np.uint64(1)
        # A rank below n and a rank ahead up to n: MOST_BITS bits each.
        packed = np.sort((rank << np.uint64(2 * MOST_BITS)) | (ahead << shift) | at)
        reach *= 2


class FMIndex:
    """text: uint8 symbols 1..31. A sentinel is appended."""

    def __init__(self, text: np.ndarray, sample: int = 8) -> None:
        text = np.append(text.astype(np.uint8), np.uint8(0))
        self.n = len(text)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        counts = np.bincount(text, minlength=1 << SYMBOL_BITS)
        self.starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        # Wavelet matrix, highest bit first: ones before each position, and the zeros of the level.
        self.ones, self.zeros = [], []
        level = bwt
        for bit in range(SYMBOL_BITS - 1, -1, -1):
            b = (level >> bit) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(b, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            level = np.concatenate([level[b == 0], level[b == 1]])
        # Where each symbol's run begins on the last level, for ranks.
        self.base = self._base()
        self.bwt = bwt
        self.sample = sample
        marked = sa % sample == 0
        self.marked = marked
        self.mark_rank = np.zeros(self.n + 1, np.int32)
        np.cumsum(marked, out=self.mark_rank[1:])
        self.sampled = sa[marked]

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(SYMBOL_BITS):
            bit = (symbols >> (SYMBOL_BITS - 1 - k)) & 1
            ones = self.ones[k][at]
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return at

    def _base(self) -> np.ndarray:
        symbols = np.arange(1 << SYMBOL_BITS)
        return self._descend(symbols, np.zeros(1 << SYMBOL_BITS, np.int64))

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position of the transform."""
        return self._descend(symbols, at) - self.base[symbols]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """patterns (m, width) of symbols -> rows [lo, hi) of the suffix array; lo == hi where there is none."""
        m, width = patterns.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        alive = np.arange(m)
        for j in range(width - 1, -1, -1):
            s = patterns[alive, j].astype(np.int64)
            a = self.starts[s] + self.rank(s, lo[alive])
            b = self.starts[s] + self.rank(s, hi[alive])
            lo[alive], hi[alive] = a, b
            alive = alive[a < b]
            if not len(alive):
                break
        gone = hi <= lo
        lo[gone] = hi[gone] = 0
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix array rows, walking back to the nearest sampled one."""
        rows = rows.astype(np.int64).copy()
        steps = np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.marked[rows])
        while len(walking):
            r = rows[walking]
            s = self.bwt[r].astype(np.int64)
            rows[walking] = self.starts[s] + self.rank(s, r)
            steps[walking] += 1
            walking = walking[~self.marked[rows[walking]]]
        return self.sampled[self.mark_rank[rows]] + steps
