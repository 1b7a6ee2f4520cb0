"""SimHash near-duplicates by the general pigeonhole principle.

Fingerprints of whole texts are compared through parts of correlated bits. Each distinct fingerprint gets its own
threshold per part (-1 skips the part; they sum to radius - parts + 1), allocated by dynamic programming on estimated
candidate counts, and probes the cells of that radius. Candidates are verified on all 64 bits.

A cell with more than CELL_LIMIT fingerprints is not expanded into pairs: for a fingerprint that would probe one, the links
don't come from probing but from its closed ball of radius 1. Two fingerprints differ in at most 2 bits exactly if those balls
meet, and a meeting point has 65 members at most, so that way is whole too and linear in the fingerprints. The limit follows from
the ball's 65 points, not from any data.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleweave.llm.common import append_columns, materialize, packed, texts_in, unpacked
from titleweave.llm.components import components

SEED, SHINGLE, RADIUS, BITS = 42, 3, 2, 64
#: Members of a cell up to which probing costs less than the 65 points of a ball.
CELL_LIMIT = 64
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def simhash_batch(texts: list[bytes | None]) -> np.ndarray:
    """Fingerprints (uint64) of whole UTF-8 texts; null, empty and blank texts get 0."""
    from xxhash import xxh64_intdigest

    out, sizes, hashes = np.zeros(len(texts), np.uint64), [], []
    for text in texts:
        words = text.translate(LOWER).split() if text else []
        n = len(words)
        parts = map(b" ".join, zip(words, words[1:], words[2:])) if n >= SHINGLE else [b" ".join(words)] if n else []
        n = max(n - SHINGLE + 1, min(n, 1))
        sizes.append(n)
        hashes.append(np.fromiter(map(xxh64_intdigest, parts, repeat(SEED)), np.uint64, n))
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + sizes[end] <= 1 << 17):
            total += sizes[end]
            end += 1
        if total:
            filled = [i for i in range(at, end) if sizes[i]]
            counts = np.zeros((len(filled), BITS), np.int64)
            if len(filled) == 1:
                h = hashes[filled[0]]
                for k in range(0, len(h), 1 << 17):
                    counts[0] += np.unpackbits(h[k : k + (1 << 17)].astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
            else:
                h = np.concatenate([hashes[i] for i in filled]).astype(">u8").view(np.uint8)
                starts = np.cumsum([0] + [sizes[i] for i in filled[:-1]])
                counts = np.add.reduceat(np.unpackbits(h).reshape(-1, BITS), starts, axis=0, dtype=np.int32)
            ns = np.array([sizes[i] for i in filled])
            out[filled] = np.packbits(counts * 2 > ns[:, None], axis=1).view(">u8").ravel().astype(np.uint64)
        at = end
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp): one row per input row, fp the fingerprint as a signed LONG, text_key a hash of the text."""

    def make():
        return lambda texts: [pa.array(simhash_batch(texts.to_pylist()).view(np.int64))]

    own = texts_in(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    return append_columns(own, make, [("fp", T.LongType())], keep=["doc_id", "text_key"])


def bit_counts(fps: DataFrame) -> np.ndarray:
    """64 x 64 co-occurrence counts of set bits; each task gives one fixed-size block, summed in Spark."""

    def run(batches):
        total = np.zeros((BITS, BITS), np.int64)
        for b in batches:
            v = b.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(v), 1 << 16):
                bits = np.unpackbits(v[k : k + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, BITS).astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel())], names=["k", "n"])

    out = np.zeros(BITS * BITS, np.int64)
    for k, n in fps.select("fp").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n")).collect():  # 4,096 rows
        out[k] = n
    return out.reshape(BITS, BITS)


def number_of_parts(n: int, radius: int = RADIUS) -> int:
    """The number of equal parts with the fewest probes and, for even bits, candidates per fingerprint."""
    from math import comb

    def cost(m: int) -> float:
        width, spare = BITS // m, radius - m + 1
        used, extra = (m, spare) if spare >= 0 else (m + spare, 0)
        probes = sum(comb(width, j) for j in range(extra + 1)) + used - 1
        return probes + probes * n / 2.0**width

    return min((2, 3, 4), key=cost)


def group_bits(co: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits (0 is the highest) dealt to parts, each grown around its most correlated bits. Widths differ by 1 at most."""
    p = np.diag(co) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(co / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        own = [max(left, key=lambda b: (corr[b, list(left)].sum(), -b))]
        left.discard(own[0])
        while len(own) < size:
            own.append(max(left, key=lambda b: (corr[b, own].sum(), -b)))
            left.discard(own[-1])
        out.append(sorted(own))
    return out


def cell_of(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for b in bits:
        out = (out << np.uint64(1)) | ((fps >> np.uint64(BITS - 1 - b)) & np.uint64(1))
    return out.astype(np.int64)


def masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.int64)


def allocate(counts: np.ndarray, fps: np.ndarray, parts: list[list[int]], share: np.ndarray, n: int, radius: int = RADIUS) -> np.ndarray:
    """Thresholds (rows x parts) of least estimated cost with sum radius - parts + 1, by dynamic programming.

    Radius 0 costs the exact size of the own cell; larger radii what independent bits with the shares seen would add.
    """
    rows, m = counts.shape
    cost = np.zeros((rows, m, radius + 2))
    for i, bits in enumerate(parts):
        near = np.zeros((rows, radius + 1))
        near[:, 0] = 1
        for b in bits:
            is_set = ((fps >> np.uint64(BITS - 1 - b)) & np.uint64(1)).astype(bool)
            differ = np.where(is_set, 1 - share[b], share[b])[:, None]
            near = near * (1 - differ) + np.pad(near[:, :-1], ((0, 0), (1, 0))) * differ
        for t in range(radius + 1):
            cost[:, i, t + 1] = len(masks(len(bits), t)) + counts[:, i] + n * near[:, 1 : t + 1].sum(1)
    low, total = -m, radius - m + 1
    width = radius * m - low + 1
    best = np.full((rows, width), np.inf)
    best[:, -low] = 0
    choice = np.zeros((rows, m, width), np.int8)
    for i in range(m):
        now = np.full((rows, width), np.inf)
        for t in range(-1, radius + 1):
            moved = np.full((rows, width), np.inf)
            src = slice(max(0, -t), width - max(0, t))
            dst = slice(max(0, t), width + min(0, t))
            moved[:, dst] = best[:, src] + cost[:, i, t + 1][:, None]
            better = moved < now
            now[better] = moved[better]
            choice[:, i][better] = t
        best = now
    out, at = np.zeros((rows, m), np.int64), np.full(rows, total - low)
    for i in reversed(range(m)):
        out[:, i] = choice[np.arange(rows), i, at]
        at -= out[:, i]
    return out


def links(fps: DataFrame, n: int, co: np.ndarray, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Edges (u, v) between the distinct fingerprints of fps(fp) that connect all that differ in at most RADIUS bits."""
    m = number_of_parts(n)
    parts, share = group_bits(co, n, m), np.diag(co) / max(n, 1)

    def cells(batches):
        for b in batches:
            v = b.column(0).to_numpy().view(np.uint64)
            columns = [np.concatenate(x) for x in zip(*[(np.full(len(v), i, np.int32), cell_of(v, bits), v.view(np.int64)) for i, bits in enumerate(parts)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["part", "cell", "fp"])

    index = fps.select("fp").mapInArrow(cells, "part int, cell long, fp long")
    sizes = materialize(index.groupBy("part", "cell").agg(F.count("*").alias("size")), "cells")
    known = index.join(sizes, ["part", "cell"]).groupBy("fp").pivot("part", list(range(m))).agg(F.max("size"))

    def probes(batches):
        for b in batches:
            v = b.column(0).to_numpy().view(np.uint64)
            counts = np.stack([b.column(1 + i).to_numpy(zero_copy_only=False) for i in range(m)], 1).astype(float)
            for k in range(0, len(v), 4096):
                some, own = v[k : k + 4096], counts[k : k + 4096]
                t = allocate(own, some, parts, share, n)
                made = []
                for i, bits in enumerate(parts):
                    for r in range(RADIUS + 1):
                        who = some[t[:, i] == r]
                        if len(who):
                            ball = masks(len(bits), r)
                            made.append((np.full(len(who) * len(ball), i, np.int32), (cell_of(who, bits)[:, None] ^ ball[None, :]).ravel(), np.repeat(who.view(np.int64), len(ball)), np.tile(ball == 0, len(who))))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made, strict=True)], names=["part", "cell", "asks", "own"])

    # a fingerprint alone in its own cell finds nothing there
    asked = materialize(known.mapInArrow(probes, "part int, cell long, asks long, own boolean").join(sizes, ["part", "cell"]).filter("not own or size > 1"), "probes")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("asks"))) <= RADIUS
    cold = asked.filter(F.col("size") <= cell_limit).select("part", "cell", "asks")
    wanted = cold.select("part", "cell").distinct()
    small = index.join(wanted, ["part", "cell"]).select("part", "cell", "fp")
    probed = cold.join(small, ["part", "cell"]).filter((F.col("fp") != F.col("asks")) & near).select(F.col("asks").alias("u"), F.col("fp").alias("v"))
    hot = asked.filter(F.col("size") > cell_limit).select("asks").distinct()
    points = F.array_append(F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.col("asks").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))), F.col("asks"))
    balls = hot.select("asks", F.explode(points).alias("point")).groupBy("point").agg(F.collect_list("asks").alias("who"))
    met = balls.filter(F.size("who") > 1).select(F.explode("who").alias("u"), F.array_min("who").alias("v"))
    return probed.unionByName(met.filter("u <> v"))


def members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp, component_id, root), one row per input row: root is the component's least fingerprint."""
    own = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    n = distinct.count()
    node = components(links(distinct, n, bit_counts(distinct))) if n > 1 else distinct.sparkSession.createDataFrame([], "node long, root long")
    known = node.join(distinct, node.node == distinct.fp).select("node", "root", "first_id")
    least = known.groupBy("root").agg(F.min("first_id").alias("least_id"))
    renamed = known.join(least, "root").select(F.col("node").alias("fp"), "root", "least_id")
    member = distinct.join(renamed, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least_id", "first_id").alias("component_id"))
    return own.join(member, "fp").select("doc_id", "text_key", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    component_id is the least doc_id reachable over links of RADIUS bits or fewer. Null, empty and blank texts have
    fingerprint 0 and link like any other; a null doc_id is never a least one; repeated rows each give a row; no rows
    give no rows. Other columns are not read.
    """
    found = members(docs, id_col, text_col)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near duplicates: that of the least (doc_id, fingerprint, hash of the text). Columns
    stay.

    Rows of one doc_id whose texts are unlike belong to groups of their own, and each group keeps one. A row without a
    doc_id can't be named as a member of a group, and stays.
    """
    found = members(docs, id_col, text_col).filter("doc_id is not null")
    named = found.groupBy("root").agg(F.min(F.struct("doc_id", "fp", "text_key")).alias("least")).select("least.doc_id", "least.text_key")
    rows = packed(docs).withColumns({"doc_id": F.col("row").getField(id_col), "text_key": F.xxhash64(F.col("row").getField(text_col).cast("string"))})
    order = Window.partitionBy("doc_id", "text_key").orderBy(F.lit(1))
    kept = rows.join(named, ["doc_id", "text_key"]).withColumn("n", F.row_number().over(order)).filter("n = 1")
    return unpacked(kept, docs).unionByName(docs.filter(F.col(f"`{id_col}`").isNull()))
