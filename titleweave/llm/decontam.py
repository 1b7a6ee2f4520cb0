"""Benchmark decontamination: the windows of benchmark items as a broadcast hash set, scanned by every document.

The set is broadcast in blocks of at most BLOCK_BYTES of item text. A benchmark beyond one block takes a pass over the
documents for each block, so what an executor holds stays bounded whatever the benchmark's size.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleweave.llm.common import append_columns, held, materialize, texts_in, unpacked

WINDOW = 13
BLOCK_BYTES = 16 << 20
#: Words are runs of digits, letters and anything that isn't ASCII; A-Z count as a-z.
TO_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")
FOUND = T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())]))
ARROW_FOUND = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))


class Windows:
    """The windows of some items, by length: sorted hashes, where each one's words stand, and its items."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        ids, spans = [], {}
        for k, (_, text) in enumerate(items):
            own = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in text.translate(TO_WORDS).split()]
            n = min(len(own), WINDOW)
            if n:
                spans.setdefault(n, []).extend((len(ids) + i, k) for i in range(len(own) - n + 1))
                ids += own
        self.words, self.names = np.array(ids, np.int64), [x for x, _ in items]
        self.by_length = {}
        for n, found in sorted(spans.items()):
            starts, owners = np.array([x for x, _ in found]), [k for _, k in found]
            rows = self.words[starts[:, None] + np.arange(n)]
            for salt in range(100):
                h = self.hashes(rows, salt)
                keys, first, group = np.unique(h, return_index=True, return_inverse=True)
                if (rows[first][group] == rows).all():  # no two different windows share a hash
                    break
            else:
                raise ValueError("window hashes collide")
            members: list[set[int]] = [set() for _ in keys]
            for g, k in zip(group.tolist(), owners, strict=True):
                members[g].add(k)
            self.by_length[n] = (keys, rows[first], members, salt)

    @staticmethod
    def hashes(rows: np.ndarray, salt: int) -> np.ndarray:
        out, base = np.zeros(len(rows), np.uint64), np.uint64(0x9E3779B97F4A7C15 + 2 * salt)
        for j in range(rows.shape[1]):
            out = (out ^ (rows[:, j].astype(np.uint64) + np.uint64(1))) * base
            out ^= out >> np.uint64(29)
        return out

    def scan(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
        """For each text its number of words, the merged word ranges that windows cover, and the items with windows in it."""
        get, ids, bounds = self.vocabulary.get, [], [0]
        for text in texts:
            if text:
                ids += [get(w, -1) for w in text.translate(TO_WORDS).split()]
            bounds.append(len(ids))
        word, at = np.array(ids, np.int64), np.array(bounds)
        unknown = np.concatenate([[0], np.cumsum(word < 0)])
        text_end = np.repeat(at[1:], np.diff(at))
        hits: dict[int, list[tuple[int, int, set[int]]]] = {}
        for n, (keys, rows, members, salt) in self.by_length.items():
            if len(word) < n:
                continue
            starts = np.arange(len(word) - n + 1)
            starts = starts[(unknown[n:] == unknown[:-n]) & (starts + n <= text_end[: len(starts)])]
            for k in range(0, len(starts), 1 << 16):
                some = starts[k : k + (1 << 16)]
                own = word[some[:, None] + np.arange(n)]
                h = self.hashes(own, salt)
                place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                same = np.flatnonzero(keys[place] == h)
                same = same[(rows[place[same]] == own[same]).all(1)]
                docs = np.searchsorted(at, some[same], "right") - 1
                for d, s, p in zip(docs.tolist(), some[same].tolist(), place[same].tolist(), strict=True):
                    hits.setdefault(d, []).append((s - bounds[d], s - bounds[d] + n, members[p]))
        out = []
        for d in range(len(texts)):
            ranges: list[tuple[int, int]] = []
            items: set[int] = set()
            for a, b, own in sorted(hits.get(d, ()), key=lambda x: x[:2]):
                items |= own
                if ranges and a <= ranges[-1][1]:
                    ranges[-1] = (ranges[-1][0], max(ranges[-1][1], b))
                else:
                    ranges.append((a, b))
            out.append((bounds[d + 1] - bounds[d], ranges, items))
        return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def without(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The text without the stretches from the first to the last word of each range."""
    places, out, last = [m.span() for m in WORD.finditer(text.translate(TO_WORDS))], [], 0
    for a, b in ranges:
        out.append(text[last : places[a][0]])
        last = places[b - 1][1]
    return b"".join(out) + text[last:]


@F.pandas_udf(FOUND)
def union(a, b):
    import pandas as pd

    return pd.Series([[{"from": p, "to": q} for p, q in merged([(r["from"], r["to"]) for r in [*x, *y]])] for x, y in zip(a, b, strict=True)])


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, text, n_words int, hits, items): each row of docs as a struct without its text, the text, the merged word ranges that benchmark
    windows cover and the ids of their items as strings, sorted.

    Null texts have no words. A null item_id counts as the empty string. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{item_text_col}`").cast("string").cast("binary").alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    out = docs.select(F.struct(others or [F.lit(True)]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    fields = [("n_words", T.IntegerType()), ("hits", FOUND), ("items", T.ArrayType(T.StringType()))]
    for k in range(blocks):
        own = [(r["item"], bytes(r["text"])) for r in items.filter(block == k).collect()]  # block_bytes or so
        told, name = spark.sparkContext.broadcast(own), uuid.uuid4().hex

        def make(told=told, name=name):
            w = held("decontam", name, lambda: Windows(told.value))

            def run(texts: pa.Array) -> list:
                found = w.scan(texts.to_pylist())
                return [[x[0] for x in found], pa.array([[{"from": a, "to": b} for a, b in x[1]] for x in found], ARROW_FOUND), [sorted({w.names[i] for i in x[2]}) for x in found]]

            return run

        out = append_columns(out.withColumnsRenamed({"hits": "hits_before", "items": "items_before"}), make, fields)
        if k:
            out = out.withColumns({"hits": union("hits", "hits_before"), "items": F.array_sort(F.array_union("items", "items_before"))}).drop("hits_before", "items_before")
        if k < blocks - 1:
            out = materialize(out, "decontam")
    return out


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with n_words, hits and items (see scan), which take the place of columns of those names."""
    new = ["n_words", "hits", "items"]
    found = scan(docs, benchmark, text_col, **options)
    return found.select([(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns if c not in new] + new)


N_HIT = "cast(aggregate(hits, 0L, (s, x) -> s + x.to - x.from) as long)"


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row per row of docs; other columns aren't read."""
    found = scan(texts_in(docs, id_col, text_col), benchmark, "text", **options).withColumn("doc_id", F.col("row.doc_id"))
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.expr(N_HIT).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), F.expr(f"{N_HIT} > 0 and 20 * {N_HIT} >= n_words").alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without contaminated documents, and without the hit stretches in those that stay. The columns stay as they are.

    Contaminated: at least 1 in 20 words is hit. A text without hits, null included, is untouched.
    """
    found = scan(docs, benchmark, text_col, **options).filter(F.expr(f"not ({N_HIT} > 0 and 20 * {N_HIT} >= n_words)"))

    @F.pandas_udf("string")
    def cut(text, hits):
        import pandas as pd

        return pd.Series([t if t is None or not len(h) else without(t.encode(), [(r["from"], r["to"]) for r in h]).decode("utf-8", "replace") for t, h in zip(text, hits, strict=True)])

    return unpacked(found, docs, **{text_col: F.when(F.size("hits") > 0, cut("text", "hits")).otherwise(F.col("text"))})


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
