"""Adaptive context-mixing range coder for ids under 2**16, in sections of blocks that are coded side by side.

One numpy step codes one id of each of up to LANES blocks, all by one model, which then learns them all at once: the
tables fit the caches, and every block profits from what the others have shown. For an id, the order-2 context's
prediction comes first, then the order-1 context's, then adaptive order-0 frequencies; an id that these don't hold yet
follows an escape as it is. How likely a prediction is right is mixed, in the logistic domain with learnt weights, from
what the orders say about it; as they say it in few different ways, each way is mixed once and its result looked up. All
arithmetic is on integers, so any machine decodes what another has coded.

A blob is MAGIC and sections of up to BLOCK * LANES ids. A section is its number of ids, ids a block, number of 16-bit
words and the CRC-32 of what follows: for each block the CRC-32 of its ids as little-endian unsigned 32-bit integers and its number of
words, then the blocks' words.
"""

from __future__ import annotations

import math
import struct
from zlib import crc32

import numpy as np

MAGIC = b"TWRC\x02"
BLOCK, LANES, SHORT = 1024, 4096, 256  # the most ids of a block, blocks side by side, ids of a block in a small section
SYMBOLS, WHOLE = 1 << 16, 1 << 16  # ids, and what the probabilities of a choice add up to
ORDER2, SURE = 18, 7  # bits of the order-2 table; the highest confidence
FULL, LEAST, HALF = 1 << 48, 1 << 32, 0xFFFFFFFF  # the range at first, and the least between two choices
FIRST, EVERY = frozenset((1, 2, 3, 4, 6, 8, 12, 16, 24)), 32  # steps after which the model is worked out anew
FORGET = 1 << 20  # choices after which the older ones count half
SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], np.int64)
STRETCH = np.array([max(-2047, min(2047, round(256 * math.log((p + 0.5) / (4095.5 - p))))) for p in range(4096)], np.int64)
#: Levels 0 to 7 of order-0 frequencies, and the stretched probability of each.
LEVEL = np.array([0] + [min(7, max(1, f.bit_length() - 4)) for f in range(1, WHOLE)], np.int64)
LEVELS = STRETCH[[0, 1, 2, 4, 8, 16, 32, 64]]
_U = np.uint64


class _Choice:
    """Of a prediction: the probability (of WHOLE) that it is right for each context, which is a place in an array of this
    shape. Each of inputs is the axes that an order's own hit rate depends on; level is the axis of order-0 levels; the
    weights depend on the place along axis own. ends: the least and the greatest probability.
    """

    def __init__(self, shape: tuple[int, ...], inputs: list[tuple[int, ...]], level: int, own: int, ends: tuple[int, int], sign: int | None = None):
        self.ends, self.shape, self.inputs, self.own, self.sign = ends, shape, inputs, own, sign
        self.size, self.other = math.prod(shape), [tuple(i for i in range(len(shape)) if i not in x) for x in inputs]
        self.seen, self.hits = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        self.weights = np.full((len(inputs) + 1, shape[own]), 65536 // 3, np.int64)
        self.levels = np.broadcast_to(LEVELS.reshape([-1 if i == level else 1 for i in range(len(shape))]), shape)
        self.along = np.broadcast_to(np.arange(shape[own]).reshape([-1 if i == own else 1 for i in range(len(shape))]), shape)
        self.mix()

    def mix(self) -> None:
        said = []
        for i, axes in enumerate(self.other):
            n, h = (x.sum(axes, keepdims=True) if axes else x for x in (self.seen, self.hits))
            s = np.broadcast_to(STRETCH[(h * 4096 + 512) // (n + 1)], self.shape)
            if i == 1 and self.sign is not None:  # what order 1 says of another id speaks against this one
                s = np.where(np.arange(2).reshape([-1 if j == self.sign else 1 for j in range(len(self.shape))]) == 1, s, -np.abs(s))
            said.append(s)
        self.said = np.stack([*said, self.levels])
        mixed = (self.weights[:, self.along] * self.said).sum(0) >> 16
        self.p = np.clip(SQUASH[np.clip(mixed, -2047, 2047) + 2047] << 4, *self.ends)
        self.table = np.append(self.p.ravel(), np.zeros(1024 - self.size, np.int64)).astype(_U)

    def learn(self, contexts: np.ndarray) -> None:
        """contexts: place * 2 + whether the prediction was right; places from size on are no choices."""
        found = np.bincount(contexts.ravel(), minlength=self.size * 2)[: self.size * 2].reshape(-1, 2)
        n, h = found.sum(1).reshape(self.shape), found[:, 1].reshape(self.shape)
        axes = tuple(i for i in range(len(self.shape)) if i != self.own)
        down = (self.said * ((h << 12) - n * (self.p >> 4))).sum(tuple(i + 1 for i in axes))
        self.weights += down // (n.sum(axes) + 64) >> 6
        self.seen += n
        self.hits += h
        if self.seen.sum() > FORGET:
            self.seen, self.hits = self.seen >> 1, self.hits >> 1
        self.mix()


class _Model:
    """What all blocks of a section have shown so far. An entry of a context's table is id | confidence << 16 | order-0 level << 19."""

    def __init__(self, n: int):
        self.order2, self.order1 = np.zeros(1 << ORDER2, np.int32), np.zeros(SYMBOLS, np.int32)
        # contexts of order 2: whether order 1 agrees, level, confidences of orders 2 and 1; of order 1: level, confidences
        self.second = _Choice((2, 8, 8, 8), [(0, 2), (0, 3), (0, 1, 2, 3)], 1, 2, (16, WHOLE - 128), 0)
        self.first = _Choice((8, 8, 8), [(1,), (0, 1, 2)], 0, 1, (1024, WHOLE - 1024))
        self.a, self.b = np.zeros(n, np.int64), np.zeros(n, np.uint32)  # the last ids, and the hash of the ones before
        self.heap2, self.heap1, self.ids = (np.full((EVERY, n), x, np.int32) for x in (self.second.size * 2, self.first.size * 2, SYMBOLS))
        self.steps = self.held = 0
        self.at = self.count = np.zeros(SYMBOLS, np.int64)
        self.settle(self.count)

    def settle(self, found: np.ndarray) -> None:
        """Order-0 frequencies of WHOLE after so many more of each id. The escape has what the ids leave: as much as ids without
        a place came among the last ones, at least.
        """
        self.count = self.count + found
        kinds, new, n = np.count_nonzero(self.count), np.count_nonzero(found[self.at == 0]), int(found.sum())
        room = WHOLE - max(1, WHOLE * new // (n + 1))
        kinds = kinds if kinds * 2 <= room else 0  # where they leave room, each has a place
        f = self.count * (room - kinds) // max(1, int(self.count.sum()))
        if kinds:
            f += self.count > 0
        ends = np.cumsum(f)
        self.at, self.known = f, int(ends[-1])
        self.place = (((ends - f) << 17) | f).astype(_U)  # where an id's part begins, and how large it is
        self.place[f == 0] = (self.known << 17) | (WHOLE - self.known)
        self.entry = (np.arange(SYMBOLS) | (1 << 16) | (LEVEL[f] << 19)).astype(np.int32)

    def ids_at(self) -> np.ndarray:
        """The id at each of the known places of order 0, and one that the escape stands for."""
        return np.append(np.repeat(np.arange(SYMBOLS), self.at), np.argmin(self.at))

    def look(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the first k blocks: the predictions of orders 2 and 1, and the probabilities that the first is right, and if not, the other."""
        a = self.a[:k]
        self.hash = a.astype(np.uint32) * np.uint32(0x9E3779B1)
        self.at2 = ((self.hash + self.b[:k]) >> np.uint32(32 - ORDER2)).astype(np.int64)
        self.e2, self.e1 = self.order2[self.at2], self.order1[a]
        self.c2, self.c1 = self.e2 & 0xFFFF, self.e1 & 0xFFFF
        h2, h1 = self.e2 >> 16, self.e1 >> 16
        self.s2, self.s1 = h2 & 7, h1 & 7
        self.agree = self.c2 == self.c1
        same = self.agree.astype(np.int32) << 9
        self.x2, self.x1 = (h2 << 3) | self.s1 | same, (h1 << 3) | self.s2 | same
        return self.c2, self.c1, self.second.table[self.x2.astype(np.int64)], self.first.table[self.x1.astype(np.int64)]

    def saw(self, k: int, ids: np.ndarray) -> bool:
        """Learn the first k blocks' ids (32-bit). Whether order 0 has changed."""
        right2, right1 = (ids == self.c2).astype(np.int32), (ids == self.c1).astype(np.int32)
        self.heap2[self.held, :k] = (self.x2 << 1) | right2
        self.heap1[self.held, :k] = ((self.x1 | (right2 << 9)) << 1) | right1  # no choice if order 2 is right or says the same
        self.ids[self.held, :k] = ids
        where = ids.astype(np.int64)
        entry = self.entry[where]
        for table, at, e, s, right in ((self.order2, self.at2, self.e2, self.s2, right2), (self.order1, self.a[:k], self.e1, self.s1, right1)):
            table[at] = np.where((s >= 2) > right, e - ((s + 1) >> 1 << 16), entry + (np.minimum(s, SURE - 1) * right << 16))
        self.b[:k] = self.hash * np.uint32(0x85EBCA6B)
        self.a[:k] = where
        self.steps += 1
        self.held += 1
        if self.held < EVERY and self.steps not in FIRST:
            return False
        self.second.learn(self.heap2[: self.held])
        self.first.learn(self.heap1[: self.held])
        found = np.bincount(self.ids[: self.held].ravel(), minlength=SYMBOLS + 1)[:SYMBOLS]
        # the last block may be shorter: what its place holds must not count again
        self.heap2[:, k:], self.heap1[:, k:], self.ids[:, k:], self.held = self.second.size * 2, self.first.size * 2, SYMBOLS, 0
        self.settle(found)
        return True


class _Writer:
    """A number for each block, in 16-bit digits. A digit may overflow until words()."""

    def __init__(self, n: int, block: int):
        self.low, self.range = np.zeros(n, _U), np.full(n, FULL, _U)
        self.width = 3 * block + 3
        self.out = np.zeros(n * self.width, np.uint32)
        self.start = np.arange(n) * self.width
        self.at = self.start.copy()

    def put(self, k: int, below: np.ndarray, size: np.ndarray) -> None:
        """Narrow the first k blocks' ranges. A size is over 2**-16 of the range, so one digit is enough."""
        self.low[:k] += below
        self.range[:k] = size
        self.shift(np.flatnonzero(size < LEAST))

    def shift(self, lane: np.ndarray) -> None:
        low, at = self.low[lane], self.at[lane]
        self.out[at] = low >> _U(32)
        self.at[lane] = at + 1
        self.low[lane] = (low & _U(HALF)) << _U(16)
        self.range[lane] <<= _U(16)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """The digits of all blocks in turn, and how many are whose. Any digits may follow a block's own."""
        self.low += _U(0xFFFF)
        for _ in range(2):
            self.shift(np.arange(len(self.low)))
        sizes = self.at - self.start
        most = int(sizes.max())
        grid = self.out.reshape(-1, self.width)[:, :most].copy()
        flat = grid.ravel()
        over = np.flatnonzero(flat > 0xFFFF)
        while len(over):
            carry = flat[over] >> 16
            flat[over] &= 0xFFFF
            flat[over - 1] += carry
            over = over[flat[over - 1] > 0xFFFF] - 1
        return grid[np.arange(most) < sizes[:, None]].astype("<u2"), sizes


class _Reader:
    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        n = len(sizes)
        self.at = np.cumsum(sizes) - sizes
        self.source = np.append(words, np.zeros(3, np.uint16)).astype(_U)
        self.ahead, self.range = np.zeros(n, _U), np.full(n, FULL, _U)
        for _ in range(3):
            self.ahead = (self.ahead << _U(16)) | self.source.take(self.at, mode="clip")
            self.at += 1

    def take(self, k: int, below: np.ndarray, size: np.ndarray) -> None:
        self.ahead[:k] -= below
        self.range[:k] = size
        lane = np.flatnonzero(size < LEAST)
        at = self.at[lane]
        self.ahead[lane] = (self.ahead[lane] << _U(16)) | self.source.take(at, mode="clip")
        self.at[lane] = at + 1
        self.range[lane] <<= _U(16)


def _code(grid: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of blocks side by side: a row of grid holds one id of each, the last block has only last ids."""
    block, n = grid.shape
    m, c = _Model(n), _Writer(n, block)
    zero = _U(0)
    for t in range(block):
        k = n if t < last else n - 1
        if not k:
            break
        ids = grid[t, :k].astype(np.int32)
        c2, c1, p2, p1 = m.look(k)
        wide = c.range[:k]
        one = (wide >> _U(16)) * p2
        left = wide - one
        other = (left >> _U(16)) * p1
        hit2 = ids == c2
        hit1 = (ids == c1) > hit2
        miss = ~(hit2 | hit1)
        c.put(k, np.where(hit2, zero, one + np.where(miss, other, zero)), np.where(hit2, one, np.where(hit1, other, left - other)))
        place = np.where(miss, m.place[ids.astype(np.int64)], _U(WHOLE))
        r = c.range[:k] >> _U(16)
        c.put(k, r * (place >> _U(17)), r * (place & _U(0x1FFFF)))
        new = np.flatnonzero((place >> _U(17)) == m.known)
        new = new[miss[new]]
        if len(new):
            r = c.range[:k] >> _U(16)
            below, size = np.zeros(k, _U), c.range[:k].copy()
            below[new], size[new] = r[new] * ids[new].astype(_U), r[new]
            c.put(k, below, size)
        m.saw(k, ids)
    return c.words()


def _decode(block: int, last: int, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    n = len(sizes)
    grid = np.zeros((block, n), np.uint16)
    m, c = _Model(n), _Reader(words, sizes)
    at, zero = m.ids_at(), _U(0)
    for t in range(block):
        k = n if t < last else n - 1
        if not k:
            break
        c2, c1, p2, p1 = m.look(k)
        wide, ahead = c.range[:k], c.ahead[:k]
        one = (wide >> _U(16)) * p2
        left = wide - one
        other = (left >> _U(16)) * p1
        hit2, miss = ahead < one, ahead >= one + other
        c.take(k, np.where(hit2, zero, one + np.where(miss, other, zero)), np.where(hit2, one, np.where(miss, left - other, other)))
        r = c.range[:k] >> _U(16)
        own = at[np.minimum(c.ahead[:k] // r, _U(m.known)).astype(np.int64)]
        place = np.where(miss, m.place[own], _U(WHOLE))
        ids = np.where(miss, own.astype(np.int32), np.where(hit2, c2, c1))
        c.take(k, r * (place >> _U(17)), r * (place & _U(0x1FFFF)))
        new = np.flatnonzero((place >> _U(17)) == m.known)
        new = new[miss[new]]
        if len(new):
            r = c.range[:k] >> _U(16)
            below, size = np.zeros(k, _U), c.range[:k].copy()
            v = np.minimum(c.ahead[new] // r[new], _U(SYMBOLS - 1))
            below[new], size[new], ids[new] = r[new] * v, r[new], v
            c.take(k, below, size)
        grid[t, :k] = ids
        if m.saw(k, ids):
            at = m.ids_at()
    return grid


def compress(ids: np.ndarray) -> bytes:
    """A blob of ids (each under 2**16)."""
    ids = np.asarray(ids)
    if len(ids) and (ids.min() < 0 or ids.max() >= SYMBOLS):
        raise ValueError("an id is out of range")
    out = [MAGIC]
    for start in range(0, len(ids), BLOCK * LANES):
        own = ids[start : start + BLOCK * LANES]
        block = min(len(own), max(SHORT, -(-len(own) // LANES)))
        n = -(-len(own) // block)
        grid = np.zeros(n * block, np.uint16)
        grid[: len(own)] = own
        words, sizes = _code(np.ascontiguousarray(grid.reshape(n, block).T), len(own) - (n - 1) * block)
        raw = own.astype("<u4")
        index = np.array([(crc32(raw[k * block : (k + 1) * block]), sizes[k]) for k in range(n)], "<u4").tobytes()
        out += [struct.pack("<IIII", len(own), block, len(words), crc32(words, crc32(index))), index, words.tobytes()]
    return b"".join(out)


def decompress(blob: bytes) -> np.ndarray:
    """The ids (uint32) of a blob. Raises ValueError where a block or a section's words aren't what their checksum says."""
    if blob[: len(MAGIC)] != MAGIC:
        raise ValueError("not a blob of token ids")
    at, out = len(MAGIC), []
    while at < len(blob):
        if at + 16 > len(blob):
            raise ValueError("a section is cut short")
        count, block, size, check = struct.unpack_from("<IIII", blob, at)
        if not 0 < block <= count <= BLOCK * LANES:
            raise ValueError("a section's sizes are wrong")
        n = -(-count // block)
        end = at + 16 + 8 * n + 2 * size
        if end > len(blob):
            raise ValueError("a section is cut short")
        if crc32(memoryview(blob)[at + 16 : end]) != check:
            raise ValueError("a section's checksum is wrong")
        index, words = np.frombuffer(blob, "<u4", 2 * n, at + 16).reshape(n, 2).astype(np.int64), np.frombuffer(blob, "<u2", size, at + 16 + 8 * n)
        raw = np.ascontiguousarray(_decode(block, count - (n - 1) * block, words, index[:, 1]).T).ravel()[:count].astype("<u4")
        if [crc32(raw[k : k + block]) for k in range(0, count, block)] != index[:, 0].tolist():
            raise ValueError("a block's checksum is wrong")
        out.append(raw)
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint32)
