"""Byte-level BPE encoding and decoding with a given vocabulary file.

Each pre-token is merged with a priority queue of merge ranks over a doubly linked list of symbols; entries whose pair has
changed since are skipped. Decoding concatenates the vocabulary's byte strings.
"""

from __future__ import annotations

import hashlib
import json
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleweave.llm.common import append_columns, held, texts_in

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens remembered by a Python worker; longer ones than CACHED_CHARS are merged each time.
CACHE_SIZE, CACHED_CHARS = 200_000, 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    names = {b: chr(b) for b in shown}
    return [names[b] if b in names else chr(next(hidden)) for b in range(256)]


class Codec(dict):
    """Encoder and decoder of one vocabulary file's text; as a dict, ids by pre-token."""

    def __init__(self, vocabulary: str):
        import regex

        super().__init__()
        told = json.loads(vocabulary)
        model, symbols = told["model"], byte_symbols()
        ids, back = model["vocab"], {c: b for b, c in enumerate(symbols)}
        self.added = {x["content"]: x["id"] for x in told.get("added_tokens") or []}
        self.first = [ids[c] for c in symbols]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a] << 20 | ids[b]] = (rank, ids[a + b])
        size = max([*ids.values(), *self.added.values()]) + 1
        self.strings, self.decimal = [b""] * size, [str(i) for i in range(size)]
        for token, i in ids.items():
            self.strings[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.added.items():
            self.strings[i] = token.encode()
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None

    def __missing__(self, token: str) -> tuple[int, ...]:
        out = self.merge(token.encode())
        if len(token) <= CACHED_CHARS:
            if len(self) >= CACHE_SIZE:
                self.clear()
            self[token] = out
        return out

    def merge(self, data: bytes) -> tuple[int, ...]:
        merges, first = self.merges, self.first
        symbol = [first[b] for b in data]
        n = len(symbol)
        if n == 1:
            return tuple(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = merges.get(symbol[i] << 20 | symbol[i + 1])
            if found:
                heap.append(found[0] * n + i)
        heapify(heap)
        while heap:
            rank, i = divmod(heappop(heap), n)
            if symbol[i] < 0 or (j := after[i]) >= n:
                continue
            found = merges.get(symbol[i] << 20 | symbol[j])
            if not found or found[0] != rank:
                continue  # stale: this pair has changed since
            symbol[i], symbol[j] = found[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get(symbol[i] << 20 | symbol[k])
                if found:
                    heappush(heap, found[0] * n + i)
            h = before[i]
            if h >= 0:
                found = merges.get(symbol[h] << 20 | symbol[i])
                if found:
                    heappush(heap, found[0] * n + h)
        return tuple(s for s in symbol if s >= 0)

    def encode(self, text: str) -> list[int]:
        if self.cut is None or not any(x in text for x in self.added):
            return list(chain.from_iterable(map(self.__getitem__, self.find(text))))
        out: list[int] = []
        for part in self.cut(text):
            if part in self.added:
                out.append(self.added[part])
            else:
                out.extend(chain.from_iterable(map(self.__getitem__, self.find(part))))
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def codec(vocabulary: str) -> Codec:
    return held("bpe", vocabulary, lambda: Codec(vocabulary))


def _vocabulary(docs: DataFrame, path: str | None):
    """The file's text, broadcast: its size doesn't grow with the data."""
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _text(x: bytes | None) -> str:
    return x.decode("utf-8", "replace") if x else ""


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """docs with ids_col array<int>. Null and empty texts give an empty array; bytes that aren't UTF-8 count as U+FFFD."""
    told = _vocabulary(docs, path)

    def make():
        c = codec(told.value)
        return lambda texts: [pa.array([c.encode(_text(x)) for x in texts.to_pylist()], pa.list_(pa.int32()))]

    return append_columns(docs, make, [(ids_col, T.ArrayType(T.IntegerType()))], text_col)


def decode(docs: DataFrame, ids_col: str = "ids", text_col: str = "decoded", path: str | None = None) -> DataFrame:
    """docs with text_col decoded from ids_col. A null array gives null; bytes that aren't UTF-8 become U+FFFD."""
    told = _vocabulary(docs, path)

    @F.pandas_udf("string")
    def decoded(ids):
        c = codec(told.value)
        return ids.map(lambda x: None if x is None else c.decode(x))

    return docs.withColumn(text_col, decoded(F.col(f"`{ids_col}`")))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode every whole text and decode the ids again: (doc_id, n_tokens, ids_sha256, decoded_sha256), a row per row.

    Null counts as empty: no ids, and the digests of the empty string. Other columns are not read.
    """
    told = _vocabulary(docs, path)

    def make():
        c = codec(told.value)
        name, sha = c.decimal.__getitem__, hashlib.sha256

        def run(texts: pa.Array) -> list:
            n, coded, decoded = [], [], []
            for x in texts.to_pylist():
                ids = c.encode(_text(x))
                n.append(len(ids))
                coded.append(sha(",".join(map(name, ids)).encode()).hexdigest())
                decoded.append(sha(c.decode(ids).encode()).hexdigest())
            return [n, coded, decoded]

        return run

    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return append_columns(texts_in(docs, id_col, text_col), make, fields, keep=["doc_id"])
