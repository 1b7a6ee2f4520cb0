"""Indel ratios (2 LCS / total length) and the best stretch for each word, in numpy over Arrow batches.

A longest common subsequence is found bit by bit, many pairs side by side: a pair's state is a row of 64-bit limbs, a bit for
each character of the second text, and one step takes the next character of every first text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bit masks that a step holds at a time, and windows of words.
MASKS, WINDOWS = 1 << 18, 1 << 17
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points end to end, and the texts' lengths."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(x) for x in texts], np.int64)


def _grid(points: np.ndarray, sizes: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """A row for each text: 1 and the place in alphabet of each character, 0 for one that isn't there and behind the end."""
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    if out.size and len(alphabet):
        place = np.minimum(np.searchsorted(alphabet, points), len(alphabet) - 1)
        out[np.arange(out.shape[1]) < sizes[:, None]] = np.where(alphabet[place] == points, place + 1, 0)
    return out


def _masks(grid: np.ndarray, letters: int) -> np.ndarray:
    """(row, letter, limb): at which places of each text a letter stands."""
    out = np.zeros((len(grid), letters + 1, max(1, -(-grid.shape[1] // 64))), np.uint64)
    rows = np.arange(len(grid))
    for j in range(grid.shape[1]):
        out[rows, grid[:, j], j // 64] |= np.uint64(1 << j % 64)
    out[:, 0] = 0
    return out


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of a[i] and b[i]."""
    out = np.zeros(len(a), np.int64)
    order = sorted(range(len(a)), key=lambda i: (-(-len(b[i]) // 64), len(a[i])))
    k = 0
    while k < len(order):
        limbs = max(1, -(-len(b[order[k]]) // 64))
        some = [i for i in order[k : k + max(1, MASKS // (48 * limbs))] if max(1, -(-len(b[i]) // 64)) == limbs]
        k += len(some)
        out[some] = _lcs_block([a[i] for i in some], [b[i] for i in some])
    return out


def _lcs_block(a: list[str], b: list[str]) -> np.ndarray:
    """lcs_lengths() of texts in order of len(a)."""
    points, sizes = _points(b)
    alphabet = np.unique(points)
    masks = _masks(_grid(points, sizes, alphabet), len(alphabet))
    steps = _grid(*_points(a), alphabet)
    open_ = np.full((masks.shape[2], len(a)), ONES)
    begun = np.searchsorted([len(x) for x in a], np.arange(steps.shape[1]), "right")  # shorter texts are done
    for i, first in enumerate(begun.tolist()):
        hit = masks[np.arange(first, len(a)), steps[first:, i]]
        carry = np.zeros(len(a) - first, np.uint64)
        for limb in range(len(open_)):
            v = open_[limb, first:]
            both = v & hit[:, limb]
            total = v + both
            over = total < v
            total += carry
            carry = (over | (total < carry)).astype(np.uint64)
            open_[limb, first:] = total | (v ^ both)
    return 64 * len(open_) - np.bitwise_count(open_).sum(0, dtype=np.int64)


def shares(common: np.ndarray, total: np.ndarray) -> np.ndarray:
    """100 times the share of the total length that isn't deleted or inserted; 100 for two empty texts."""
    return np.where(total == 0, 100.0, (2 * common) / np.maximum(total, 1) * 100)


def word_stretches(titles: list[str], truths: list[str], limit: int) -> tuple[list[list[int]], list[str]]:
    """For each of a truth's first words, the highest truncated ratio of a stretch of the title without its blanks, as long as
    the word or up to the title's end, and the leftmost such stretch (a blank where nothing is alike); stretches are joined by
    blanks.
    """
    number: dict[tuple[str, str], int] = {}
    wanted = [[number.setdefault((t, w), len(number)) for w in m.split(" ")[:limit]] for t, m in zip(titles, truths, strict=True)]
    items = [(t.replace(" ", ""), w) for t, w in number]
    best: list[tuple[int, str]] = [(0, " ")] * len(items)
    order = sorted((i for i, (t, w) in enumerate(items) if t and w), key=lambda i: -len(items[i][1]))
    k = 0
    while k < len(order):
        some, windows = [], 0
        while k < len(order) and (not some or windows + len(items[order[k]][0]) <= WINDOWS):
            windows += len(items[order[k]][0])
            some.append(order[k])
            k += 1
        for i, found in zip(some, _stretches([items[i] for i in some]), strict=True):
            best[i] = found
    return [[best[i][0] for i in own] for own in wanted], [" ".join(best[i][1] for i in own) for own in wanted]


def _stretches(items: list[tuple[str, str]]) -> list[tuple[int, str]]:
    """(ratio, stretch) of (solid title, word), words in falling order of length."""
    points, sizes = _points([w for _, w in items])
    solid, spans = _points([t for t, _ in items])
    width = int(sizes.max())
    item = np.repeat(np.arange(len(items)), spans)
    begin = np.cumsum(spans) - spans
    start = np.arange(len(item)) - np.repeat(begin, spans)
    part = np.minimum(sizes[item], spans[item] - start)
    if width > 64:  # not a word of ordinary length: every stretch is a pair of its own
        common = lcs_lengths([items[i][0][s : s + n] for i, s, n in zip(item.tolist(), start.tolist(), part.tolist(), strict=True)], [items[i][1] for i in item.tolist()])
    else:
        alphabet = np.unique(points)
        masks = _masks(_grid(points, sizes, alphabet), len(alphabet))[:, :, 0].ravel()
        place = np.minimum(np.searchsorted(alphabet, solid), len(alphabet) - 1)
        code = np.append(np.where(alphabet[place] == solid, place + 1, 0), 0)
        row = item * (len(alphabet) + 1)
        open_, active = np.full(len(item), ONES), np.append(np.cumsum(spans), 0)
        for j in range(width):
            n = int(active[np.count_nonzero(sizes > j) - 1])  # windows of words that are that long
            inside = j < part[:n]
            hit = masks[row[:n] + np.where(inside, code[np.minimum(np.arange(n) + j, len(solid))], 0)]
            v = open_[:n]
            both = v & hit
            open_[:n] = (v + both) | (v ^ both)
        common = 64 - np.bitwise_count(open_).astype(np.int64)
    ratio = shares(common, sizes[item] + part).astype(np.int64)
    top = np.maximum.reduceat((ratio << 32) - start, begin)
    value = -((-top) >> 32)
    at = (value << 32) - top
    return [(v, t[s : s + n] if v else " ") for v, s, n, (t, _) in zip(value.tolist(), at.tolist(), sizes.tolist(), items, strict=True)]


def lcs(a: Column, b: Column) -> Column:
    def common(x: pd.Series, y: pd.Series) -> pd.Series:
        there = (x.notna() & y.notna()).to_numpy()
        out = pd.Series([None] * len(x), dtype="Int32", index=x.index)
        out[there] = lcs_lengths(x[there].tolist(), y[there].tolist())
        return out

    return F.pandas_udf(common, T.IntegerType())(a, b)


def _whole(x: Column, y: Column) -> Column:
    return F.length(x) + F.length(y)


def ratio_of(common: Column, total: Column) -> Column:
    """shares() as an expression."""
    return F.when(total == 0, F.lit(100.0)).otherwise((2 * common).cast("double") / total * 100)


def indel_ratio(a: Column, b: Column) -> Column:
    """Rounded half to even."""
    return F.rint(ratio_of(lcs(a, b), _whole(a, b))).cast("int")


def indel_ratio_truncated(a: Column, b: Column) -> Column:
    return F.floor(ratio_of(lcs(a, b), _whole(a, b))).cast("int")


def sorted_words(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(text, " ")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return indel_ratio(sorted_words(a), sorted_words(b))


def near_ratios(a: list[str], b: list[str], threshold: float) -> np.ndarray:
    """Rounded ratios, or where one is no more than threshold, that of the sorted words."""
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64)
    out = np.rint(shares(lcs_lengths(a, b), total)).astype(np.int64)
    low = np.flatnonzero(out <= threshold)
    by_word = lambda texts: [" ".join(sorted(texts[i].split(" "))) for i in low]
    out[low] = np.rint(shares(lcs_lengths(by_word(a), by_word(b)), total[low])).astype(np.int64)
    return out


def with_near_ratio(pairs: DataFrame, threshold: float) -> DataFrame:
    """pairs(title, match, ...) over the threshold, with ratio. A step of its own, so that no ratio is worked out twice."""
    at = [pairs.columns.index(c) for c in ("title", "match")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = near_ratios(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist(), threshold)
            good = pa.array(np.flatnonzero(found > threshold))
            yield pa.RecordBatch.from_arrays([*[c.take(good) for c in batch.columns], pa.array(found.astype(np.int32)).take(good)], names=[*batch.schema.names, "ratio"])

    return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField("ratio", T.IntegerType())]))


def length_bound(a: Column, b: Column) -> Column:
    """The highest ratio that lengths allow, in percent."""
    total = _whole(a, b)
    return F.when(total == 0, F.lit(100.0)).otherwise((total - F.abs(F.length(a) - F.length(b))).cast("double") / total * 100)


def word_matches(title: Column, truth: Column, limit: int) -> Column:
    """struct<ratios: array<int>, rebuilt: string>: see word_stretches. Null where a title is."""

    def matched(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        there = (a.notna() & b.notna()).to_numpy()
        out = pd.DataFrame({"ratios": [None] * len(a), "rebuilt": [None] * len(a)}, dtype=object)
        ratios, rebuilt = word_stretches(a[there].tolist(), b[there].tolist(), limit)
        for i, r, t in zip(np.flatnonzero(there).tolist(), ratios, rebuilt, strict=True):
            out.iat[i, 0], out.iat[i, 1] = r, t
        return out

    kind = T.StructType([T.StructField("ratios", T.ArrayType(T.IntegerType())), T.StructField("rebuilt", T.StringType())])
    return F.pandas_udf(matched, kind)(title, truth)
