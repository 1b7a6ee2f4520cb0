"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of itself and its character n-grams, each with an embedding in a hashed table; a text is the average of
all its bags. A misspelling shares most n-gram vectors with the word that it stands for.
"""

from __future__ import annotations

import pickle
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleweave.llm.common import append_columns, held, texts_in

#: Bounds of the learning sample, chosen by a hash of doc_id: expected numbers of labelled documents and of their bytes.
LEARN_DOCS, LEARN_BYTES = 6000, 64 << 20
BUCKETS, DIM, GRAMS = 1 << 18, 4, (3, 4, 5)
#: One rate for all embeddings keeps rare subwords, which see few gradients, near where they began.
EPOCHS, RATE, DECAY = 300, 0.003, 1e-4
#: Of the average, whose size is that of one bucket among thousands.
SCALE = np.float32(30)
THRESHOLD = 0.3
CACHE_SIZE = 250_000
#: Characters of a long word whose grams are held at a time, and of the longest word that is kept in the cache.
STRETCH, CACHED = 1 << 14, 64
PUNCTUATION = ".,;:!?\"'()[]{}|<>%&$*-"


def normal(token: str) -> str:
    return token.strip(PUNCTUATION) or token


def bag(word: str) -> list[int]:
    """Buckets of the word itself and its character n-grams, whatever its length."""
    edged = f"<{word}>"
    return [crc32(edged.encode()) % BUCKETS] + [crc32(edged[i : i + n].encode(), n) % BUCKETS for n in GRAMS for i in range(len(edged) - n + 1)]


def bags(word: str) -> Iterator[list[int]]:
    """bag() in parts of bounded size: each gram starts in one stretch of STRETCH characters."""
    if len(word) <= STRETCH:
        yield bag(word)
        return
    edged = f"<{word}>"
    yield [crc32(edged.encode()) % BUCKETS]
    for k in range(0, len(edged), STRETCH):
        yield [crc32(edged[i : i + n].encode(), n) % BUCKETS for n in GRAMS for i in range(k, min(k + STRETCH, len(edged) - n + 1))]


def start(live: int, rate: float, seed: int) -> dict[str, np.ndarray]:
    """Embeddings, softmax weights and bias before the first step."""
    random = np.random.default_rng(seed)
    return {"e": random.normal(0, 0.1, (DIM, live)).astype(np.float32), "w": random.normal(0, 1, DIM).astype(np.float32), "b": np.full(1, np.log(rate / (1 - rate)), np.float32)}


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> bytes:
    """A pickled (per-bucket logit, bias): embeddings and softmax learnt together on all rows at once, by Adam with one
    second moment for each of the three.

    As the layers above the embeddings are linear, each bucket's embedding times the softmax weights is one number, and
    all gradients follow from one number for each bucket. Every subword of the sample is learnt, however rare.
    """
    known: dict[str, int] = {}
    docs = []
    for text in texts:
        own: dict[int, int] = {}
        for token in text.lower().split():
            k = known.setdefault(normal(token), len(known))
            own[k] = own.get(k, 0) + 1
        docs.append(own)
    y = np.array(labels, np.float32)
    if not known or not 0 < y.sum() < len(y):
        rate = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        return pickle.dumps((np.zeros(BUCKETS, np.float32), float(np.log(rate / (1 - rate)))))
    flat, sizes = array("i"), np.zeros(len(known), np.int64)
    for k, w in enumerate(known):
        for part in bags(w):
            sizes[k] += len(part)
            flat.extend(part)
    live, column = np.unique(np.frombuffer(flat, np.int32), return_inverse=True)
    used = np.array([d for d, own in enumerate(docs) for _ in own], np.int64)
    words = np.array([k for own in docs for k in own], np.int64)
    counts = np.array([n for own in docs for n in own.values()], np.float32)
    weight = counts / np.bincount(used, counts * sizes[words], len(docs)).astype(np.float32)[used]
    # the same sums by word, document and bucket again and again: each as one run of a sorted array
    word_at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    docs_with = np.flatnonzero([len(x) > 0 for x in docs])
    used_at = np.searchsorted(used, docs_with)
    order = np.argsort(words, kind="stable")
    seen_at, used_by_word, weight_by_word = np.searchsorted(words[order], np.arange(len(known))), used[order], weight[order]
    by_column = np.argsort(column, kind="stable")
    column_at, word_by_column = np.searchsorted(column[by_column], np.arange(len(live))), np.repeat(np.arange(len(known)), sizes)[by_column]
    state = start(len(live), float(y.mean()), seed)
    e, w, b = state["e"], state["w"], state["b"]
    first, second = {k: np.zeros_like(v) for k, v in state.items()}, dict.fromkeys(state, 0.0)
    for step in range(1, epochs + 1):
        logit = np.full(len(docs), b[0])
        logit[docs_with] += np.add.reduceat(np.add.reduceat((w @ e * SCALE)[column], word_at)[words] * weight, used_at)
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)
        by_bucket = np.add.reduceat((np.add.reduceat(d[used_by_word] * weight_by_word, seen_at) * SCALE)[word_by_column], column_at)
        for k, g in (("e", np.outer(w, by_bucket) + DECAY * e / len(live)), ("w", e @ by_bucket), ("b", d.sum(keepdims=True))):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * float(np.mean(g * g))
            state[k] -= (RATE / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)) * first[k]
    table = np.zeros(BUCKETS, np.float32)
    table[live] = w @ e * SCALE
    return pickle.dumps((table, float(b[0])))


class Scorer(dict):
    """Per token the sum of its bag's logits and the bag's size; the score is the sigmoid of their ratio over a text."""

    def __init__(self, model: bytes):
        super().__init__()
        table, self.bias = pickle.loads(model)
        self.table = table.tolist()

    def __missing__(self, token: str) -> tuple[float, int]:
        total, size = 0, 0
        for own in bags(normal(token)):
            total += sum(map(self.table.__getitem__, own))
            size += len(own)
        out = (total, size)
        if len(token) <= CACHED:
            if len(self) >= CACHE_SIZE:
                self.clear()
            self[token] = out
        return out

    def score(self, text: str | None) -> float:
        tokens = text.lower().split() if text else []
        if not tokens:
            return float(1 / (1 + np.exp(-self.bias)))
        sums, sizes = zip(*map(self.__getitem__, tokens), strict=True)
        return float(1 / (1 + np.exp(-np.clip(sum(sums) / sum(sizes) + self.bias, -30, 30))))


def scorer(model: bytes) -> Scorer:
    return held("toxicity", model, lambda: Scorer(model))


def fold(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", use_fold: bool = True) -> bytes:
    """Learn from a bounded sample of labelled rows (LEARN_DOCS, LEARN_BYTES) outside the held-out fold, whole texts.

    Of several labels of a document the largest counts; null labels and texts are left out.
    """
    told = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    if use_fold:
        told = told.filter(~fold(F.col("doc_id")))
    own = texts_in(docs, id_col, text_col).filter("text is not null")
    n, size = own.select("doc_id", F.octet_length("text").cast("long").alias("size")).join(told, "doc_id").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = min(1.0, LEARN_DOCS / max(n, 1), LEARN_BYTES / max(size, 1))
    sample = told.filter(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) < int(share * (1 << 20)))
    found = own.join(sample, "doc_id").select("doc_id", "text", "label").toArrow()  # LEARN_BYTES or so
    rows = sorted(zip(found["doc_id"].to_pylist(), found["text"].cast(pa.binary()).to_pylist(), found["label"].to_pylist(), strict=True))
    return train([x[1].decode("utf-8", "replace") for x in rows], [int(x[2] > 0) for x in rows])


def append_score(docs: DataFrame, model: bytes, text_col: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs with the probability of the label. Null and blank texts get the prior."""
    told = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def make():
        s = scorer(told.value)
        return lambda texts: [pa.array([s.score(x.decode("utf-8", "replace") if x else None) for x in texts.to_pylist()], pa.float64())]

    return append_columns(docs, make, [(name, T.DoubleType())], text_col, keep)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs; the held-out fold is never learnt from.

    Null and blank texts get the share of the label in the sample. A null doc_id counts as the empty string for the fold.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    out = append_score(texts_in(docs, id_col, text_col), model, keep=["doc_id"])
    return out.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
