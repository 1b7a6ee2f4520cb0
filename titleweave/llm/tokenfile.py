"""Token ids in a compressed binary file format, written in ascending doc_id order and read back.

A dataset is a Parquet folder (so any store that Spark reaches will do, and a lost executor's attempt leaves nothing): a
row is a chunk of whole documents in order, with their ids and lengths and one range-coded blob of their token ids. Chunks
are ordered by (shard, chunk).
"""

from __future__ import annotations

import re
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from titleweave.llm.common import fresh_path, held, texts_in, trim
from titleweave.llm.rangecoder import BLOCK, LANES, compress, decompress

END = 2
#: Ids that make a chunk full; a longer document is a chunk by itself.
CHUNK = BLOCK * LANES
#: Words remembered by a Python worker; longer ones than CACHED bytes are encoded each time. Bytes of text split at a time.
CACHE_SIZE, CACHED, STEP = 800_000, 64, 8 << 20
#: With the steps of FOLDS and PARTS before its model, a vocabulary sees these letters in lower case, and never as one with the TAIL
#: characters after them.
LETTERS, TAIL = "A-Za-zÀ-ÖØ-öø-ÿ", "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
EACH = "".join(chr(i) for i in range(256) if re.match(f"[{LETTERS}]", chr(i)))
FOLDS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Words of printable ASCII without what begins a contraction or an added token, and their parts.
ASCII, PIECES = re.compile(rb"[!-&(-;=-~]+").fullmatch, re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+").findall


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches that begin at starts, in turn."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Words:
    """Ids by word, made by the tokenizers library; texts are split and put together in Arrow and numpy.

    The vocabulary's pre-tokenizer must drop white space, so that no token crosses it and a text's ids are those of its words in
    turn; a vocabulary of which that isn't true is refused. Where the vocabulary has the steps of FOLDS and PARTS, a word of LETTERS
    is remembered in lower case and apart from the TAIL after it, and other words of printable ASCII by their parts.
    """

    def __init__(self, vocabulary: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        if ids(" a \t\n b\x0b\x0c\r") != ids("a") + ids("b"):
            raise ValueError("the vocabulary's tokens cross white space")
        told = json.loads(vocabulary)
        first = ((told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        apart = (first.get("pattern"), first.get("behavior"), first.get("invert")) == ({"Regex": PARTS}, "Removed", True)
        marks = all("<" in x["content"] for x in told.get("added_tokens") or [])
        self.folds = apart and marks and (told.get("normalizer") or {}).get("normalizers") == FOLDS
        self.clear()

    def clear(self) -> None:
        """rows: a word's row; a row's ids are those of pool from its start to the next one's."""
        self.rows, self.pool, self.starts = {b"": 0}, np.zeros(0, np.uint32), np.zeros(2, np.int64)

    def encode(self, texts: pa.Array, last: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) in turn, each followed by last, and how many are whose."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        each = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        kinds = coded.dictionary
        stem = pc.ascii_rtrim(kinds, characters=TAIL)
        plain = pc.match_substring_regex(stem, f"^[{LETTERS}]+$") if self.folds else pa.array(np.zeros(len(kinds), bool))
        parts = [pc.utf8_lower(stem.filter(plain)), pc.utf8_ltrim(kinds.filter(plain), characters=EACH), kinds.filter(pc.invert(plain))]
        parts = [x.dictionary_encode() for x in parts]
        keys = [x.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist() for x in parts]
        long = self.learn(*keys)
        rows, at = np.zeros((len(kinds), 2), np.int64), plain.to_numpy(zero_copy_only=False)
        for (lane, side), own, x in zip(((at, 0), (at, 1), (~at, 0)), keys, parts, strict=True):
            rows[lane, side] = np.fromiter(map(self.rows.__getitem__, own), np.int64, len(own))[x.indices.to_numpy()]
        sizes = self.starts[rows + 1] - self.starts[rows]
        own = np.append(self.pool[_spread(self.starts[rows].ravel(), sizes.ravel())], np.array(last, np.uint32))
        if long:
            self.forget(long)
        ends = np.cumsum(np.append(sizes.sum(1), len(last)))
        lists = pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), own)
        word = np.insert(coded.indices.to_numpy(), np.cumsum(each), len(kinds))  # last is one more kind, after each text
        found = lists.take(pa.array(word))
        return found.flatten().to_numpy(), np.diff(found.offsets.to_numpy()[np.cumsum(each + 1)], prepend=0).astype(np.int64)

    def learn(self, stems: list[bytes], tails: list[bytes], others: list[bytes]) -> list[bytes]:
        """Rows for words. Returns those to forget after use, whose rows are the last."""
        if len(self.rows) + sum(w not in self.rows for x in (stems, tails, others) for w in x) > CACHE_SIZE:
            self.clear()
        long = list({w for x in (stems, tails, others) for w in x if len(w) > CACHED})
        self.add(self.together([w for w in stems if w not in self.rows and len(w) <= CACHED]))
        self.add(self.apart([w for w in tails if w not in self.rows and len(w) <= CACHED]))
        others = [w for w in others if w not in self.rows and len(w) <= CACHED]
        taken = [w for w in others if self.folds and ASCII(w)]
        if taken:
            split = [PIECES(w.lower()) for w in taken]
            new = set().union(*split) - self.rows.keys()
            self.add(self.apart([w for w in new if not w.isalpha()]))
            self.add(self.together([w for w in new if w.isalpha()]))
            ids = {w: self.pool[self.starts[i] : self.starts[i + 1]].tolist() for w in set().union(*split) for i in (self.rows[w],)}
            self.add([(w, [i for x in own for i in ids[x]]) for w, own in zip(taken, split, strict=True) if w not in self.rows])
        self.add(self.apart([w for w in others if w not in self.rows]))
        self.add(self.apart(long))
        return long

    def add(self, found: list[tuple[bytes, list[int]]]) -> None:
        if found:
            sizes = [len(x) for _, x in found]
            self.rows.update(zip((w for w, _ in found), range(len(self.starts) - 1, len(self.starts) - 1 + len(found)), strict=True))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(x for _, x in found), np.uint32, sum(sizes))])

    def forget(self, words: list[bytes]) -> None:
        for w in words:
            del self.rows[w]
        self.starts = self.starts[: len(self.starts) - len(words)]
        self.pool = self.pool[: self.starts[-1]]

    def apart(self, words: list[bytes]) -> list[tuple[bytes, list[int]]]:
        found = []
        for k in range(0, len(words), 10_000):
            some = words[k : k + 10_000]
            found += zip(some, (e.ids for e in self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in some], add_special_tokens=False)), strict=True)
        return found

    def together(self, words: list[bytes]) -> list[tuple[bytes, list[int]]]:
        """Of words of letters, each of which is one word to the library, too."""
        found = []
        for k in range(0, len(words), 1000):
            some = words[k : k + 1000]
            e = self.tokenizer.encode(b" ".join(some).decode("utf-8"), add_special_tokens=False)
            ids, whose = e.ids, np.array(e.word_ids)
            cuts = np.searchsorted(whose, np.arange(len(some) + 1)).tolist()
            if len(some) != whose[-1] + 1:
                raise ValueError("the vocabulary takes words apart that it was not to")
            found += [(w, ids[i:j]) for w, i, j in zip(some, cuts, cuts[1:], strict=False)]
        return found


def words_of(vocabulary: str) -> Words:
    return held("tokens", vocabulary, lambda: Words(vocabulary))


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end: int | None = END) -> None:
    """Encode every whole text (null: empty), append end, and write the ids to path in ascending doc_id order, null first.

    Repeated rows are written each, side by side; no rows make a dataset without chunks. Other columns are not read.
    """
    spark = docs.sparkSession
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        told = spark.sparkContext.broadcast(f.read())
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("doc_id").asc_nulls_first()
    dealt = texts_in(docs, id_col, text_col).repartitionByRange(shards, order).sortWithinPartitions(order, F.col("text").asc_nulls_first())
    id_type = next(t for n, t in dealt.dtypes if n == "doc_id")
    arrow_id = pa.int64() if id_type == "bigint" else None

    def run(batches):
        from pyspark import TaskContext

        encoder, shard, chunk = words_of(told.value), TaskContext.get().partitionId(), 0
        names, sizes, parts, total = [], [], [], 0
        last = [] if end is None else [end]

        def blob():
            columns = [pa.array([shard]), pa.array([chunk]), pa.array([total]), pa.array([names], pa.list_(arrow_id) if arrow_id else None), pa.array([sizes], pa.list_(pa.int64())), pa.array([compress(np.concatenate(parts))], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "chunk", "n_ids", "doc_ids", "sizes", "data"])

        for b in batches:
            took = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // STEP
            cuts = [0, *(np.flatnonzero(np.diff(took)) + 1).tolist(), b.num_rows]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                ids, texts = b.column(0).slice(start, stop - start).to_pylist(), b.column(1).slice(start, stop - start)
                own, own_sizes = encoder.encode(texts, last)
                ends = np.cumsum(own_sizes)
                i = done = 0
                while i < len(ids):
                    j = int(np.searchsorted(ends, done + CHUNK - total, "right"))
                    if j <= i and total:
                        yield blob()
                        names, sizes, parts, total, chunk = [], [], [], 0, chunk + 1
                        continue
                    j = max(j, i + 1)
                    names += ids[i:j]
                    sizes += own_sizes[i:j].tolist()
                    parts.append(own[done : ends[j - 1]])
                    total += int(ends[j - 1]) - done
                    i, done = j, int(ends[j - 1])
            trim()
        if names:
            yield blob()

    dealt.mapInArrow(run, f"shard long, chunk long, n_ids long, doc_ids array<{id_type}>, sizes array<long>, data binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, shard, chunk, at, n_tokens, ids_crc32[, ids]) of each document of a dataset, every block's checksum checked.

    at: the ids before the document in its chunk.
    """
    chunks = spark.read.parquet(path)
    id_type = next(t for n, t in chunks.dtypes if n == "doc_ids")[6:-1]
    fields = f"doc_id {id_type}, shard long, chunk long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def run(batches):
        for b in batches:
            for shard, chunk, names, sizes, data in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                found = decompress(data)
                ends = np.cumsum(sizes)
                if ends[-1] != len(found):
                    raise ValueError("a chunk's sizes don't fit its ids")
                parts = [found[e - n : e] for e, n in zip(ends.tolist(), sizes, strict=True)]
                columns = [pa.array(names, b.schema.field(2).type.value_type), pa.array([shard] * len(names)), pa.array([chunk] * len(names)), pa.array(ends - np.array(sizes)), pa.array(sizes, pa.int64()), pa.array([crc32(x) for x in parts], pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(found.astype(np.int32))))
                trim()
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "shard", "chunk", "at", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    return chunks.select("shard", "chunk", "doc_ids", "sizes", "data").mapInArrow(run, fields)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, chunk, first): the ids in all chunks before. Only one row of each shard meets in one task."""
    sizes = spark.read.parquet(path).select("shard", "chunk", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    over = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("shard", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    own = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return own.join(base, "shard").select("shard", "chunk", (F.col("base") + F.col("inside")).alias("first"))


def write_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, path: str | None = None) -> DataFrame:
    """Write docs' ids and read them back: (doc_id, start, n_tokens, ids_crc32), one row per row of docs."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    write_tokens(docs, path, id_col, text_col, vocabulary)
    found = read_tokens(spark, path, ids=False)
    return found.join(starts(spark, path), ["shard", "chunk"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
