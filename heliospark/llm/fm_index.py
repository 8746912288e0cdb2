"""A compressed FM-index in numpy: the Burrows-Wheeler transform in a wavelet matrix, searched backwards, many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Start positions in the order of their next symbols, at least ``depth`` of them; what then is equal, in any order.

    Backward search of patterns up to that depth needs no more: their intervals never cut such ties.
    """
    n = len(text)
    rank = np.asarray(text, np.int64)
    order, done = np.argsort(rank, kind="stable"), 1
    while done < depth:
        nxt = np.zeros(n, np.int64)
        nxt[:-done] = rank[done:] + 1 if done < n else 0
        both = rank * np.int64(max(n, int(rank.max()) + 1) + 2) + nxt
        order = np.argsort(both)
        ordered = both[order]
        new = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        done *= 2
        if new[-1] == n - 1 or done >= n:
            break
    return order


class WaveletMatrix:
    """Bits of a sequence level by level, 64 to a word, with the ones before each word."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.n = len(symbols)
        self.bits, self.ones, self.zeros = [], [], []
        seq = symbols
        for level in range(self.levels):
            bit = ((seq >> (self.levels - 1 - level)) & 1).astype(np.uint8)
            padded = np.zeros(-(-(self.n + 1) // 64) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.bits.append(words)
            self.ones.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1])).astype(np.int32))
            self.zeros.append(self.n - int(bit.sum()))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where prefixes of length i end among the symbols' own runs on the lowest level."""
        for level in range(self.levels):
            at = i >> 6
            ones = self.ones[level][at] + np.bitwise_count(self.bits[level][at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where((symbol >> (self.levels - 1 - level)) & 1, self.zeros[level] + ones, i - ones)
        return i


class FMIndex:
    """text: symbols from 0 to size - 1; weight: of each position, for counting."""

    def __init__(self, text: np.ndarray, size: int, weight: np.ndarray, depth: int):
        order = suffix_order(text, depth)
        self.n = len(text)
        self.tree = WaveletMatrix(text[order - 1], size)
        counts = np.bincount(text, minlength=size)
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        every = np.arange(size)
        self.shift = first - self.tree.place(every, np.zeros(size, np.int64))
        self.total = np.concatenate(([0], np.cumsum(weight[order])))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step backwards: the intervals of symbol + pattern."""
        both = self.tree.place(np.concatenate((symbol, symbol)), np.concatenate((low, high))) + np.tile(self.shift[symbol], 2)
        return both[: len(low)], both[len(low) :]

    def count(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.total[high] - self.total[low]

    def matching(self, text: np.ndarray, end: np.ndarray, most: np.ndarray, least: int = 2) -> np.ndarray:
        """Matching statistics: by pattern end (its last position in text), the longest length up to ``most`` that occurs ``least`` times, by weight."""
        length = np.zeros(len(end), np.int64)
        low, high, live = np.zeros(len(end), np.int64), np.full(len(end), self.n, np.int64), np.flatnonzero(most > 0)
        while len(live):
            lo, hi = self.extend(text[end[live] - length[live]], low[live], high[live])
            ok = self.count(lo, hi) >= least
            live = live[ok]
            low[live], high[live] = lo[ok], hi[ok]
            length[live] += 1
            live = live[length[live] < most[live]]
        return length


def repeated_windows(words: np.ndarray, bounds: np.ndarray, weight: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that occur twice or more: segment, first window, number of windows.

    words: symbols of all segments, bounds: where each begins and the last ends; weight: how often each segment occurs.
    A segment that occurs twice leaves nothing in doubt. Others are streamed against the index, from the left: the match
    that ends with the next window in doubt; if it is cut short, no window over the cut is repeated, and the next one in
    doubt begins behind the cut.
    """
    n = len(bounds) - 1
    sizes = np.diff(bounds)
    seg, first, count = [np.flatnonzero(weight >= 2)], [np.zeros(int((weight >= 2).sum()), np.int64)], [sizes[weight >= 2] - width + 1]
    single = np.flatnonzero((weight < 2) & (sizes >= width))
    if len(single):
        seen, symbols = np.unique(words, return_inverse=True)
        text = np.zeros(len(words) + n, np.int64)  # symbol 0 parts the segments
        place = np.arange(len(words)) + np.repeat(np.arange(n), sizes)
        text[place] = symbols + 1
        begins = bounds[:-1] + np.arange(n)
        own = np.ones(len(text), np.int64)
        own[place] = np.repeat(weight, sizes)
        index = FMIndex(text, len(seen) + 1, own, width)
        at, size = begins[single], sizes[single]
        s, top = np.zeros(len(single), np.int64), size - width
        live = np.flatnonzero(s <= top)
        while len(live):
            got = index.matching(text, at[live] + s[live] + width - 1, np.full(len(live), width))
            hit = got >= width
            seg.append(single[live[hit]])
            first.append(s[live[hit]])
            count.append(np.ones(int(hit.sum()), np.int64))
            s[live] += np.where(hit, 1, width - got)
            live = live[s[live] <= top[live]]
    return np.concatenate(seg), np.concatenate(first), np.concatenate(count)
