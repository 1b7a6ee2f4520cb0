"""A compressed FM-index over integer symbols: Burrows-Wheeler transform in a wavelet matrix of packed bits."""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits with a count before each 64."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)
        self.zeros = int(len(bits) - np.count_nonzero(bits))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class Wavelet:
    """Rank of any symbol in a sequence, one bit vector for each binary digit."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels, now = [], symbols
        for k in reversed(range(max(1, (sigma - 1).bit_length()))):
            bit = (now >> k) & 1
            self.levels.append((k, Bits(bit)))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol among the first i."""
        start, end = np.zeros(len(i), np.int64), i
        both = np.concatenate([start, end])
        symbol = np.concatenate([symbol, symbol])
        for k, bits in self.levels:
            ones = bits.rank(both)
            both = np.where((symbol >> k) & 1, bits.zeros + ones, both - ones)
        return both[len(i) :] - both[: len(i)]


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ordered by the depth symbols that follow, by prefix doubling, the text taken as a ring; and at each place of
    that order the number of its class, positions whose depth symbols are alike being one class.
    """
    n, have = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while have < depth:
        base, key, reach = int(rank.max()) + 1, rank, have
        room = base
        while reach < depth and room * base < 1 << 62:  # as many stretches as a key has room for, the last ending at depth
            step = min(reach, depth - have)
            key = key * base + np.roll(rank, -step)
            reach, room = step + have, room * base
        order = np.argsort(key, kind="stable")
        own = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(own[1:] != own[:-1])])
        have = reach
    order = np.argsort(rank, kind="stable")
    return order, rank[order]


class FMIndex:
    """Finds stretches of depth symbols in text, whose symbols are 0 (a separator) to sigma - 1."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        self.order, self.classes = suffix_order(text, depth)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.last = Wavelet(text[self.order - 1], sigma)
        self.n, self.depth = len(text), depth

    def extend(self, c: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of matches with intervals a to b, after a symbol c is put before each."""
        both = self.last.rank(np.concatenate([c, c]), np.concatenate([a, b]))
        return self.first[c] + both[: len(c)], self.first[c] + both[len(c) :]

    def stream(self, texts: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Matching statistics of streamed texts (end to end; where each begins, its size) against the threshold depth: at
        each place the class of the depth symbols from there, -1 where the longest match from there is shorter.

        Every text is read backward; a match grows to the left as long as it occurs. Where it can't, no stretch over both
        of its ends occurs, so the search goes on with the last end that is still possible.
        """
        out = np.full(len(texts), -1, np.int64)
        lane = np.flatnonzero(size >= self.depth)
        end, at = size[lane], size[lane]
        a, b = np.zeros(len(lane), np.int64), np.full(len(lane), self.n)
        while len(lane):
            x, y = self.extend(texts[begin[lane] + at - 1], a, b)
            grown = x < y
            end = np.where(grown, end, np.minimum(end - 1, at - 1 + self.depth))
            at = np.where(grown, at - 1, end)
            a, b = np.where(grown, x, 0), np.where(grown, y, self.n)
            hit = np.flatnonzero(grown & (end - at >= self.depth))
            out[begin[lane[hit]] + at[hit]] = self.classes[a[hit]]
            live = (at > 0) & (end >= self.depth)
            if not live.all():
                lane, end, at, a, b = lane[live], end[live], at[live], a[live], b[live]
        return out
