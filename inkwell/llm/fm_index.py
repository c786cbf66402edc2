"""Compressed FM-index over integer words: a wavelet matrix of packed bits with block counts, and batched backward search."""

from __future__ import annotations

import numpy as np


def truncated_suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first depth words at least (ties in any fixed order), by prefix doubling.

    Backward search for patterns of up to depth words needs no more order than this.
    """
    n = len(ids)
    rank, width = ids.astype(np.int64), 1
    while True:
        ahead = np.full(n, -1, dtype=np.int64)
        ahead[: max(0, n - width)] = rank[width:]
        key = rank * (n + 2) + ahead + 1
        order = np.argsort(key, kind="stable")
        width *= 2
        if width >= depth:
            return order
        new = np.empty(n, dtype=np.int64)
        sorted_key = key[order]
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = new
        if rank.max(initial=0) == n - 1:
            return order


class WaveletMatrix:
    """rank(c, i) over a sequence of integers, in log2(alphabet) bits a symbol plus block counts."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.words, self.blocks, self.zeros = [], [], []
        seq = symbols.astype(np.int64)
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, dtype=np.uint8)
            padded[: self.n] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.blocks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(self.n - bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        block = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.blocks[level][block] + np.bitwise_count(self.words[level][block] & below)

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often each symbol stands before lo and before hi, for arrays of queries; and where its run starts."""
        base = np.zeros(len(symbol), dtype=np.int64)
        for level in range(self.bits):
            one = symbol >> (self.bits - 1 - level) & 1 == 1
            ones = [self._ones(level, x) for x in (base, lo, hi)]
            base, lo, hi = (np.where(one, self.zeros[level] + o, x - o) for x, o in zip((base, lo, hi), ones, strict=True))
        return lo - base, hi - base, base


class FMIndex:
    """Index of segments (arrays of word ids from 1), each with an owner; searches ask for a smaller owner."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, owners: np.ndarray, depth: int):
        """flat: the ids of all segments in order; starts: where each begins, and the end."""
        sizes = np.diff(starts)
        text = np.zeros(len(flat) + len(sizes), dtype=np.int64)  # 0 stands after each segment
        self.starts = starts[:-1] + np.arange(len(sizes))
        places = np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)
        text[places] = flat
        self.text = text
        self.sigma = int(text.max(initial=0)) + 1
        order = truncated_suffix_array(text, depth)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self.matrix = WaveletMatrix(text[order - 1], max(1, int(self.sigma - 1).bit_length()))
        each = np.repeat(owners, sizes + 1)[order]
        # Least owner of any run of rows: a sparse table over powers of two.
        self.least = [each]
        while 2 << len(self.least) - 1 <= len(each):
            half = 1 << len(self.least) - 1
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def least_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.empty(len(lo), dtype=self.least[0].dtype)
        power = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for p in np.unique(power):
            at = np.flatnonzero(power == p)
            out[at] = np.minimum(self.least[p][lo[at]], self.least[p][hi[at] - (1 << int(p))])
        return out

    def match_back(self, end: np.ndarray, stop: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """For patterns that end before text place end: the least start >= stop from which the words up to end
        stand in a segment of a smaller owner (end itself if not even the last word does). All patterns step together."""
        reach = end.copy()
        live = np.arange(len(end))
        lo, hi = np.zeros(len(end), dtype=np.int64), np.full(len(end), len(self.text), dtype=np.int64)
        live = live[reach > stop]
        while len(live):
            c = self.text[reach[live] - 1]
            below, upto, _ = self.matrix.rank(c, lo[live], hi[live])
            a, b = self.first[c] + below, self.first[c] + upto
            some = b > a
            some[some] = self.least_owner(a[some], b[some]) < owner[live[some]]
            live, a, b = live[some], a[some], b[some]
            lo[live], hi[live] = a, b
            reach[live] -= 1
            live = live[reach[live] > stop[live]]
        return reach


def matched_windows(index: FMIndex, sizes: np.ndarray, owners: np.ndarray, window: int) -> np.ndarray:
    """For all windows of all segments in order, whether each stands in a segment of a smaller owner.

    Matching statistics are asked for only where they can decide something: one search from the end of a run of
    undecided windows settles all windows that it spans, and one from the end of the run's first window jumps over all
    windows that hold what was not found.
    """
    counts = sizes - window + 1
    offsets = np.concatenate([[0], np.cumsum(counts)])
    found = np.zeros(int(offsets[-1]) + 1, dtype=np.int64)  # differences, summed at the end
    run = np.arange(len(sizes))
    s1, s2 = np.zeros(len(sizes), dtype=np.int64), counts - 1  # undecided windows of each run, in segment places

    def take(which: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        ok = a <= b
        np.add.at(found, offsets[which[ok]] + a[ok], 1)
        np.add.at(found, offsets[which[ok]] + b[ok] + 1, -1)

    while len(run):
        base = index.starts[run]
        # From the right: windows that start at or after the reach stand in a smaller owner.
        reach = index.match_back(base + s2 + window, base + s1, owners[run]) - base
        take(run, np.maximum(reach, s1), s2)
        s2 = np.minimum(s2, reach - 1)
        left = s1 <= s2
        run, s1, s2 = run[left], s1[left], s2[left]
        if not len(run):
            break
        # From the left: the first window is found, or all windows up to the word that failed are not.
        base = index.starts[run]
        reach = index.match_back(base + s1 + window, base + s1, owners[run]) - base
        hit = reach <= s1
        take(run[hit], s1[hit], s1[hit])
        s1 = np.where(hit, s1 + 1, reach)
        left = s1 <= s2
        run, s1, s2 = run[left], s1[left], s2[left]
        # Halve runs that are still long, so that what matches in the middle is met by searches from both halves.
        long = s2 - s1 >= 4
        mid = (s1 + s2) // 2
        run, s1, s2 = np.concatenate([run, run[long]]), np.concatenate([s1, mid[long] + 1]), np.concatenate([np.where(long, mid, s2), s2[long]])
    return np.cumsum(found[:-1]) > 0
