"""Cutting documents' words into segments: runs of windows with one minimiser, so that equal windows get equal keys.

A window is SPAN consecutive words; its minimiser is the least hash of its GRAM-word grams. The windows of a maximal run
with one minimiser make up a segment. A window's minimiser depends on its words alone, so wherever a window
stands, its segment has the same key.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from xxhash import xxh64_intdigest

SPAN, GRAM = 13, 4
#: Windows of the longest segment; a longer run, as of one word again and again, is cut, all parts having its key.
MOST = 256
#: Odd 64-bit base of the content hash of a segment.
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: Bytes that end a word; a number for each byte.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
#: Bytes hashed at a time; a word of more than LONG bytes is hashed by itself.
CHUNK, LONG = 1 << 16, 64


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, end to end, and where each text's words end.

    A word's hash is a polynomial of its bytes' numbers, taken from sums over all bytes of a chunk; a long word's is XXH64.
    """
    data = np.frombuffer(b" ".join([b"", *(x or b"" for x in texts), b""]), np.uint8)
    blank = BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    stops = np.minimum(ends, starts + LONG)
    top, out, k = _chunk_powers(), np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        a, n = starts[k], np.searchsorted(starts, starts[k] + CHUNK)
        own = LETTER[data[a : stops[n - 1]]] * top[: stops[n - 1] - a]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)])
        out[k:n] = (total[stops[k:n] - a] - total[starts[k:n] - a]) * top[CHUNK - (starts[k:n] - a)]
        k = n
    out = mix(out)
    for i in np.flatnonzero(ends - starts > LONG):
        out[i] = xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out, np.searchsorted(starts, np.cumsum([len(x or b"") + 1 for x in texts]))


@lru_cache(maxsize=1)
def _chunk_powers() -> np.ndarray:
    return powers(CHUNK + LONG + 1)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out *= np.uint64(BASE)
        out += h[j : len(h) - n + 1 + j]
    return mix(out)


def powers(n: int) -> np.ndarray:
    """BASE to the 0th ... (n-1)th, modulo 2**64."""
    out = np.full(n, np.uint64(BASE))
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def cut(h: np.ndarray, ends: np.ndarray, span: int = SPAN, gram: int = GRAM, contents: bool = True):
    """Segments of the documents whose word hashes lie end to end in h: (document, first word in it, windows, key, content hash).

    ends: where each document ends. The content hash is a polynomial of the segment's words.
    """
    starts = np.concatenate([[0], ends[:-1]])
    none = np.zeros(0, np.int64)
    if len(h) < span:
        return none, none, none, none, none
    g = grams(h, gram)
    width = span - gram + 1  # grams of a window
    least, have = g, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    count = len(h) - span + 1
    least = least[:count]
    doc = np.repeat(np.arange(len(ends)), ends - starts)
    whole = doc[:count] == doc[span - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return none, none, none, none, none
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate([first, [len(at)]]))
    if len(n) and n.max() > MOST:
        parts = -(-n // MOST)
        inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, n = np.repeat(first, parts) + inside * MOST, np.minimum(np.repeat(n, parts) - inside * MOST, MOST)
    where = at[first]
    owner = doc[where]
    if not contents:
        return owner, where - starts[owner], n, least[where].view(np.int64), none
    top = powers(len(h) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h) * top[: len(h)], dtype=np.uint64)])
    # the sum from a to b, shifted to the end of the array so that it doesn't depend on where it stands
    content = (total[where + n + span - 1] - total[where]) * top[len(h) - where]
    content = mix(content * inverse_top(len(h)))
    return owner, where - starts[owner], n, least[where].view(np.int64), content.view(np.int64)


def inverse_top(n: int) -> np.uint64:
    """The inverse of BASE**n modulo 2**64."""
    return np.uint64(pow(pow(BASE, n, 1 << 64), -1, 1 << 64))
