"""Substring dedup: words covered by windows that also start in a document with a smaller id are removed.

Documents are cut into segments (see segments.py) whose keys more than one document has. Distinct segments, each read once
from its first document, are dealt to shards by key. A shard's segments make up a compressed FM-index and are streamed through
it: where the longest match is a window or more, all places of the window are at hand, and its first owner is the least id
among them. The shards' answers then go back to all documents that have the segment.

A key with more than HOT_SEGMENTS distinct segments would make one shard large: its segments are taken apart into windows,
and distinct windows are dealt, indexed and searched like the segments of other keys.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleweave.llm.common import discard, materialize, packed, steps
from titleweave.llm.fmindex import FMIndex
from titleweave.llm.segments import SPAN, cut, word_hashes

SHARD_WORDS, HOT_SEGMENTS = 250_000, 1000
LEAST_ID = -(1 << 63)


def _segments(own: DataFrame, contents: bool) -> DataFrame:
    """(key, id[, twin, start, n, content]) of every segment of own(id, twin, text)."""
    names = ["key", "id"] + ["twin", "start", "n", "content"] * contents

    def run(batches):
        for whole in batches:
            for b in steps(whole, 2):
                hashes, ends = word_hashes(b.column(2).cast(pa.binary()).to_pylist())
                doc, start, n, key, content = cut(hashes, ends, SPAN, contents=contents)
                columns = [key, b.column(0).to_numpy()[doc]]
                if contents:
                    columns += [b.column(1).to_numpy()[doc], start.astype(np.int32), n.astype(np.int32), content]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    return own.mapInArrow(run, "key long, id long" + ", twin long, start int, n int, content long" * contents)


def _fetch(docs: DataFrame) -> DataFrame:
    """The words of wanted segments of docs(text, wanted): a row for each, or for each window of a hot one."""

    def run(batches):
        for whole in batches:
            for b in steps(whole, 0):
                rows = []
                for text, wanted in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
                    words = text.split()
                    for w in wanted:
                        at, n = w["start"], w["n"]
                        base = (w["key"], w["content"], n, w["id"], w["most"], w["hot"])
                        if w["hot"]:
                            rows += [(*base, i, 1, b" ".join(words[at + i : at + i + SPAN])) for i in range(n)]
                        else:
                            rows.append((*base, 0, n, b" ".join(words[at : at + n + SPAN - 1])))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, types, strict=True)], names=["key", "content", "n", "id", "most", "hot", "off", "len", "words"])

    return docs.mapInArrow(run, "key long, content long, n int, id long, most long, hot boolean, off int, len int, words binary")


def _owners(shard: pa.Table) -> pa.Table:
    """First owners of a shard's windows: runs (key, content, n, hot, off, len, owner) of those with owner < most."""
    number: dict[bytes, int] = {}
    words = [x.split(b" ") for x in shard["words"].to_pylist()]
    sizes = np.array([len(x) + 1 for x in words])
    text = np.zeros(sizes.sum(), np.int64)
    inside = np.ones(len(text), bool)
    inside[np.cumsum(sizes) - 1] = False
    text[inside] = [number.setdefault(w, len(number) + 1) for w in chain.from_iterable(words)]
    index = FMIndex(text, len(number) + 1, SPAN)
    segment = np.repeat(np.arange(len(words)), sizes)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    found = index.stream(text, begin, sizes - 1)
    starts = np.flatnonzero(np.diff(index.classes, prepend=-1))
    least = np.minimum.reduceat(shard["id"].to_numpy()[segment[index.order]], starts)
    at = np.flatnonzero(found >= 0)
    owner, segment = least[found[at]], segment[at]
    off = at - begin[segment]
    new = np.ones(len(at), bool)
    new[1:] = (segment[1:] != segment[:-1]) | (owner[1:] != owner[:-1]) | (off[1:] != off[:-1] + 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(at)))
    use = owner[first] < shard["most"].to_numpy()[segment[first]]
    first, length = first[use], length[use]
    take = lambda c: pa.array(shard[c].to_numpy()[segment[first]])
    return pa.table([take("key"), take("content"), take("n"), take("hot"), pa.array(off[first].astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(owner[first])], names=["key", "content", "n", "hot", "off", "len", "owner"])


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, twin, text) for the search; twin tells texts apart that share an id, null ids being the least."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LEAST_ID)).alias("id"), F.xxhash64(text).alias("twin"), text.alias("text")).filter("text is not null")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, twin, spans): for each document with such windows, the ranges of words they cover; see _numbered."""
    spark = docs.sparkSession
    own = _numbered(docs, id_col, text_col)
    shared = _segments(own, False).groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("key")
    found = materialize(_segments(own, True).join(shared, "key", "left_semi"), "segments")
    distinct = found.groupBy("key", "content", "n").agg(F.min(F.struct("id", "twin", "start")).alias("rep"), F.max("id").alias("most"))
    distinct = materialize(distinct.select("key", "content", "n", "rep.*", "most"), "distinct")
    many = distinct.groupBy("key").agg(F.count("*").alias("many"), F.sum(F.col("n") + SPAN).alias("words"), F.sum("n").alias("windows"))
    is_hot = F.col("many") > HOT_SEGMENTS
    wanted = distinct.join(many.select("key", is_hot.alias("hot")), "key").groupBy("id", "twin").agg(F.collect_list(F.struct("key", "content", "n", "start", "id", "most", "hot")).alias("wanted"))
    fetched = materialize(_fetch(own.join(wanted, ["id", "twin"]).dropDuplicates(["id", "twin"]).select("text", "wanted")), "fetched")
    total = many.agg(F.sum(F.when(is_hot, F.col("windows") * (SPAN + 1)).otherwise(F.col("words")))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_WORDS))
    windows = fetched.filter("hot").withColumns({"one": F.xxhash64("words"), "two": F.xxhash64(F.lit(1), "words")})
    apart = windows.groupBy("one", "two").agg(F.min("id").alias("id"), F.max("most").alias("most"), F.first("words").alias("words"))
    pieces = fetched.filter("not hot").select("key", "content", "n", "hot", "id", "most", "words").unionByName(apart.select(F.col("one").alias("key"), F.col("two").alias("content"), F.lit(1).alias("n"), F.lit(True).alias("hot"), "id", "most", "words"))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("key", F.lit("shard")), F.lit(shards)))
    owners = materialize(dealt.groupBy("shard").applyInArrow(_owners, "key long, content long, n int, hot boolean, off int, len int, owner long"), "owners")
    back = windows.join(owners.filter("hot").select(F.col("key").alias("one"), F.col("content").alias("two"), "owner"), ["one", "two"]).filter("owner < most")
    columns = ["key", "content", "n", "off", "len", "owner"]
    runs = materialize(owners.filter("not hot").select(columns).unionByName(back.select(columns)), "runs")
    discard(fetched)
    discard(distinct)
    discard(owners)
    hits = found.join(runs, ["key", "content", "n"]).filter("owner < id")
    return hits.groupBy("id", "twin").agg(F.collect_list(F.struct((F.col("start") + F.col("off")).alias("from"), (F.col("start") + F.col("off") + F.col("len") + (SPAN - 1)).alias("to"))).alias("spans"))


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, spans): each row of docs as a struct, and the ranges of its words to remove, null where there are none."""
    spans = repeats(docs, id_col, text_col)
    keyed = packed(docs).select("row", F.coalesce(F.col("row").getField(id_col).cast("long"), F.lit(LEAST_ID)).alias("id"), F.xxhash64(F.col("row").getField(text_col).cast("string")).alias("twin"))
    return keyed.join(spans, ["id", "twin"], "left").select("row", "spans")


def kept_words(words: list[bytes], spans: list | None) -> list[bytes]:
    if not spans:
        return words
    out, last = [], 0
    for a, b in sorted((s["from"], s["to"]) for s in spans):
        if a > last:
            out += words[last:a]
        last = max(last, b)
    return out + words[last:]


def _over_spans(df: DataFrame, fn, schema: T.StructType, text_col: str, keep: list[str]) -> DataFrame:
    row = F.col("row")
    source = df.select([row.getField(c).alias(f"c{i}") for i, c in enumerate(keep)] + [row.getField(text_col).cast("string").alias("text"), "spans"])
    n = len(keep)

    def run(batches):
        for whole in batches:
            for b in steps(whole, n):
                words = [x.split() if x else [] for x in b.column(n).cast(pa.binary()).to_pylist()]
                kept = [kept_words(w, s) for w, s in zip(words, b.column(n + 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(n)] + fn(words, kept), names=schema.names)

    return source.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "kept") -> DataFrame:
    """docs with column out: the words that stay, joined by one space. Null texts have no words; see report."""
    fn = lambda words, kept: [pa.array([b" ".join(k).decode("utf-8", "replace") for k in kept])]
    keep = [c for c in docs.columns if c != out]
    schema = T.StructType([f for f in docs.schema.fields if f.name != out] + [T.StructField(out, T.StringType())])
    return _over_spans(with_spans(docs, id_col, text_col), fn, schema, text_col, keep)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per row of docs.

    Null, empty and short texts lose nothing; windows are judged on the input; a null doc_id is less than any other;
    rows with one doc_id don't remove each other's words. doc_id is an integer. Other columns are not read.
    """

    def fn(words, kept):
        sha = hashlib.sha256
        return [pa.array([len(w) for w in words], pa.int64()), pa.array([len(w) - len(k) for w, k in zip(words, kept, strict=True)], pa.int64()), pa.array([sha(b" ".join(k)).hexdigest() for k in kept], pa.string())]

    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([own.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return _over_spans(with_spans(own), fn, schema, "text", ["doc_id"])


