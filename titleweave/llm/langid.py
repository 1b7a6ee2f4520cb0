"""Language identification by segmentation-marginalised unigrams over the pieces of a public vocabulary.

For each language, every piece has a probability, learnt by expectation maximisation. A word's probability is the sum
over all its segmentations into pieces (forward algorithm); a text's is the product over its words.
"""

from __future__ import annotations

import pickle
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleweave.llm.common import append_columns, held, texts_in, trim, unused

#: Bounds of the learning sample, chosen by a hash of doc_id: expected numbers of a language's documents and of their
#: bytes; languages, the most frequent first.
DOCS_PER_LANG, LEARN_BYTES, LANGS = 800, 16 << 20, 200
ROUNDS, SMOOTHING = 4, 0.05
#: Probability of a letter with no piece.
UNSEEN = 1e-7
START = "▁"
#: Words remembered by a Python worker; longer ones than CACHED letters are scored each time. Letters of words of one length
#: that are looked up at a time.
CACHE_SIZE, CACHED, LETTERS = 120_000, 64, 1 << 15
UNDETERMINED = "und"


def vocabulary(path: str | None = None) -> list[str]:
    """All lower-case pieces of letters, with START kept where a piece begins a word."""
    import public_tokenizers
    import regex
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    fits = regex.compile(START + r"?\p{L}+|" + START).fullmatch
    return sorted({p for p in (model.id_to_piece(i).lower() for i in range(model.get_piece_size())) if fits(p)})


class Pieces:
    """Finds pieces by a rolling hash of their characters in a two-level table."""

    def __init__(self, names: list[str]):
        self.n, self.longest, keys = len(names), max(map(len, names), default=1), np.zeros(len(names), np.uint64)
        for i, name in enumerate(names):
            keys[i] = self.key(np.array([[ord(c) for c in name]], np.uint64))[0]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("piece hashes collide")
        self.keys, self.order = np.sort(keys), np.argsort(keys)
        self.slot_bits = 20
        slot = (self.keys >> np.uint64(64 - self.slot_bits)).astype(np.int64)
        self.from_slot = np.searchsorted(slot, np.arange((1 << self.slot_bits) + 1)).astype(np.int32)

    @staticmethod
    def key(rows: np.ndarray) -> np.ndarray:
        h = np.full(len(rows), rows.shape[1], np.uint64)
        for j in range(rows.shape[1]):
            h = (h ^ rows[:, j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        return h * np.uint64(0xD6E8FEB86659FD93)

    def find(self, rows: np.ndarray) -> np.ndarray:
        """Piece numbers of rows of code points; -1 where there is none."""
        h = self.key(rows)
        slot = (h >> np.uint64(64 - self.slot_bits)).astype(np.int64)
        at, end = self.from_slot[slot], self.from_slot[slot + 1]
        out = np.full(len(rows), -1, np.int64)
        todo = np.flatnonzero(at < end)
        while len(todo):
            same = self.keys[at[todo]] == h[todo]
            out[todo[same]] = self.order[at[todo[same]]]
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out

    def ending(self, words: np.ndarray, j: int) -> list[np.ndarray]:
        """For words of one length, the pieces of 1, 2, ... characters that end at j; single letters always have one, n
        standing for none.
        """
        out = [self.find(words[:, j - d : j]) for d in range(1, min(self.longest, j) + 1)]
        out[0][out[0] < 0] = self.n
        return out

    def windows(self, word: np.ndarray) -> np.ndarray:
        """ending() of all places of one word, a row for each; -1 where there is none."""
        out = np.full((len(word), self.longest), -1, np.int64)
        for d in range(1, min(self.longest, len(word)) + 1):
            for k in range(0, len(word) - d + 1, LETTERS):
                part = word[k : k + LETTERS + d - 1]
                out[k + d - 1 : k + len(part), d - 1] = self.find(np.lib.stride_tricks.sliding_window_view(part, d))
        out[out[:, 0] < 0, 0] = self.n
        return out


def by_length(words: list[str]):
    """Index and code point rows (START first) of words by length, in blocks of LETTERS letters or so."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        where, size = np.flatnonzero(lengths == n), max(1, LETTERS // int(n))
        for k in range(0, len(where), size):
            some = where[k : k + size]
            rows = np.array([[ord(START), *map(ord, words[i])] for i in some.tolist()], np.uint64)
            yield some, rows


class Model:
    def __init__(self, pieces: list[str], langs: list[str], table: np.ndarray):
        self.pieces, self.langs, self.table = Pieces(pieces), langs, table  # table: pieces + the unseen letter + none, by language
        self.known: dict[str, int] = {}
        self.logs = np.zeros((0, len(langs)))

    def forward(self, rows: np.ndarray) -> np.ndarray:
        """Logarithms of the probabilities of words of one length: sums over all segmentations, place by place, kept for
        the longest piece's length and scaled as they go, so that no length is too long.
        """
        if len(rows) == 1 and rows.shape[1] > CACHED:
            return running_sums(self.pieces.windows(rows[0]), self.table)[-1:]
        last: list[np.ndarray] = [np.ones((len(rows), len(self.langs)))]  # the sum up to the place before, and those before it
        logs = np.zeros((len(rows), len(self.langs)))
        for j in range(1, rows.shape[1] + 1):
            now = sum(a * self.table[found] for a, found in zip(last, self.pieces.ending(rows, j), strict=False))
            last = [now, *last[: self.pieces.longest - 1]]
            if j % 8 == 0:
                logs += np.log(now)
                last = [a / now for a in last]
        return logs + np.log(last[0])

    def word_logs(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)))
        for where, rows in by_length(words):
            out[where] = self.forward(rows)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language and its posterior (even prior) of each text; UNDETERMINED and 0 without a letter."""
        find, known = letters(), self.known
        words = [find(t.lower()) if t else [] for t in texts]
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        every = set().union(*words)
        long = [w for w in every if len(w) > CACHED]
        new = every - known.keys() - set(long)
        if len(known) + len(new) > CACHE_SIZE:
            known.clear()
            new, self.logs = every - set(long), np.zeros((0, len(self.langs)))
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.logs = np.concatenate([self.logs, self.word_logs(list(new))])
        apart = dict(zip(long, self.word_logs(long), strict=True))
        lang, score = [], np.zeros(len(texts))
        for i, own in enumerate(words):
            if not own:
                lang.append(UNDETERMINED)
                continue
            total = np.zeros(len(self.langs))
            if apart:
                total += sum((apart[w] for w in own if w in apart), np.zeros(len(self.langs)))
                own = [w for w in own if w not in apart]
            total += self.logs[np.fromiter(map(known.__getitem__, own), np.int64, len(own))].sum(0)
            best = int(total.argmax())
            lang.append(self.langs[best])
            score[i] = 1 / np.exp(total - total[best]).sum()
        return lang, score


@lru_cache(1)
def letters():
    import regex

    return regex.compile(r"\p{L}+").findall


def _sum_logs(terms: list[np.ndarray]) -> np.ndarray:
    top = np.maximum.reduce(terms)
    return top + np.log(sum(np.exp(x - top) for x in terms))


def running_sums(found: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For one long word, logarithms of the sums over all segmentations of its beginnings. found: see Pieces.windows."""
    last, sums = np.zeros((found.shape[1], table.shape[1])), np.ones((len(found) + 1, table.shape[1]))
    last[0] = 1
    for j in range(len(found)):
        now = (last * table[found[j]]).sum(0)
        sums[j + 1] = now
        last[1:] = last[:-1]
        last[0] = now
        last /= now
    return np.cumsum(np.log(sums), 0)


def expected_in_one(own: np.ndarray, found: np.ndarray, table: np.ndarray) -> np.ndarray:
    """expected() of one long word."""
    n, longest = found.shape
    alpha = running_sums(found, table)
    mirrored = np.full_like(found, -1)  # from the word's end: the pieces that begin where those of found end
    for d in range(1, min(longest, n) + 1):
        mirrored[d - 1 :, d - 1] = found[d - 1 :, d - 1][::-1]
    beta = running_sums(mirrored, table)[::-1]
    seen = np.zeros_like(table)
    for d in range(1, min(longest, n) + 1):
        at = np.flatnonzero(found[:, d - 1] >= 0)
        piece = found[at, d - 1]
        mass = np.exp(alpha[at + 1 - d] + beta[at + 1] - alpha[n]) * table[piece] * own
        for c in range(table.shape[1]):
            seen[:, c] += np.bincount(piece, mass[:, c], len(table))
    return seen


def expected(own: np.ndarray, endings: list[list[np.ndarray]], logs: np.ndarray) -> np.ndarray:
    """How often each piece is expected in words (own: how often each stands, by language): forward and backward sums over
    all segmentations, as logarithms.
    """
    n = len(endings)
    alpha, beta = [np.zeros(own.shape)], [np.zeros(own.shape)] * (n + 1)
    for j in range(1, n + 1):
        alpha.append(_sum_logs([alpha[j - d] + logs[found] for d, found in enumerate(endings[j - 1], 1)]))
    for i in reversed(range(n)):
        beta[i] = _sum_logs([beta[i + d] + logs[endings[i + d - 1][d - 1]] for d in range(1, n - i + 1) if d <= len(endings[i + d - 1])])
    pieces, mass = [], []
    for j in range(1, n + 1):
        for d, found in enumerate(endings[j - 1], 1):
            some = np.flatnonzero(found >= 0)
            pieces.append(found[some])
            mass.append(np.exp(alpha[j - d][some] + logs[found[some]] + beta[j][some] - alpha[n][some]) * own[some])
    at, mass = np.concatenate(pieces), np.concatenate(mass)
    return np.stack([np.bincount(at, mass[:, c], len(logs)) for c in range(own.shape[1])], 1)


def learn(counts: list[tuple[str, str, int]], pieces: list[str]) -> bytes:
    """A pickled (pieces, langs, table) from (lang, word, count) rows, by ROUNDS of expectation maximisation."""
    return learn_table(pa.table([pa.array(x, t) for x, t in zip(list(zip(*counts, strict=True)) or [[]] * 3, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"]), pieces)


def weights(counts: pa.Table) -> tuple[list[str], list[str], np.ndarray]:
    """Languages and words, both in order, and how often each word stands in each language. Of the rows themselves, which are
    many times the words, none becomes a Python object.
    """
    names, at = [], []
    for column in ("lang", "word"):
        own = pa.concat_arrays([pa.nulls(0, pa.string()), *(x.cast(pa.string()) for x in counts[column].chunks)]).dictionary_encode()
        found = own.dictionary.to_pylist()
        order = sorted(range(len(found)), key=found.__getitem__)
        place = np.zeros(len(found), np.int64)
        place[order] = np.arange(len(found))
        names.append([found[i] for i in order])
        at.append(place[own.indices.to_numpy()])
    weight = np.zeros((len(names[1]), len(names[0])))
    np.add.at(weight, (at[1], at[0]), counts["n"].to_numpy())
    return *names, weight


def learn_table(counts: pa.Table, pieces: list[str]) -> bytes:
    """learn() of a table with the columns lang, word and n."""
    langs, words, weight = weights(counts)
    at_word = {x: i for i, x in enumerate(words)}
    n, k = len(pieces), len(langs)
    table = np.full((n + 2, k), 1 / max(n, 1))
    table[n], table[n + 1] = UNSEEN, 0  # found -1 reads the last row: no such piece
    index = Pieces(pieces)
    short, long = [w for w in words if len(w) <= CACHED], [w for w in words if len(w) > CACHED]
    at_short = np.array([at_word[w] for w in short], np.int64)
    blocks = [(weight[at_short[where]], [[x.astype(np.int32) for x in index.ending(rows, j)] for j in range(1, rows.shape[1] + 1)]) for where, rows in by_length(short)]
    wide = [(weight[at_word[w]], index.windows(np.array([ord(START), *map(ord, w)], np.uint64)).astype(np.int32)) for w in long]
    for _ in range(ROUNDS if langs else 0):
        with np.errstate(divide="ignore"):
            logs = np.log(table)
        seen = sum(expected(own, endings, logs) for own, endings in blocks) + sum(expected_in_one(own, found, table) for own, found in wide)
        base = seen[:n].sum(1, keepdims=True)
        table[:n] = seen[:n] + SMOOTHING + base / max(base.sum(), 1) * 100
        table[:n] /= table[:n].sum(0)
        table[n], table[n + 1] = UNSEEN, 0
    return pickle.dumps((pieces, langs, table))


def loaded(model: bytes) -> Model:
    return held("langid", model, lambda: Model(*pickle.loads(model)))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", path: str | None = None, held_out_remainder: int | None = 1) -> bytes:
    """Learn from a bounded sample of the rows with a language (DOCS_PER_LANG, LEARN_BYTES, LANGS), outside the held-out
    fold, whole texts.

    Which rows: those whose hash of doc_id lies under a share that its language's numbers of rows and bytes set. No such
    rows give a model that answers UNDETERMINED.
    """
    own = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).filter("text is not null and lang is not null")
    if held_out_remainder is not None:
        own = own.filter(F.coalesce(F.crc32(F.coalesce("id", F.lit("")).cast("binary")), F.lit(0)) % 3 != held_out_remainder)
    sizes = own.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("size"))
    share = {r["lang"]: min(1.0, DOCS_PER_LANG / r["n"], LEARN_BYTES / max(r["size"], 1)) for r in sizes.orderBy(F.col("n").desc(), "lang").limit(LANGS).collect()}
    if not share:
        return learn([], vocabulary(path))
    part = F.lit(0.0)
    for lang, x in share.items():
        part = F.when(F.col("lang") == lang, F.lit(x)).otherwise(part)
    sample = own.filter(F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1 << 20)) < part * (1 << 20))

    def words(batches):
        from collections import Counter

        find = letters()
        for b in batches:
            seen: Counter = Counter()
            for text, lang in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.update((lang, w) for w in find(text.decode("utf-8", "replace").lower()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in seen], pa.string()), pa.array([x[1] for x in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

    counts = sample.select("text", "lang").mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    model = learn_table(counts.toArrow(), vocabulary(path))
    trim()  # the driver goes on
    return model


def append_language(docs: DataFrame, model: bytes, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs with the predicted language and its score. Null texts and texts without a letter get UNDETERMINED and 0."""
    told = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages; doesn't grow with the rows

    def make():
        m = loaded(told.value)

        def run(texts: pa.Array) -> list:
            lang, score = m.predict([x.decode("utf-8", "replace") if x else None for x in texts.to_pylist()])
            return [pa.array(lang, pa.string()), pa.array(score)]

        return run

    return append_columns(docs, make, [(lang_name, T.StringType()), (score_name, T.DoubleType())], text_col, keep)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", path: str | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of docs; rows of the held-out fold are never learnt from.

    A null doc_id counts as the empty string for the fold. Other columns are not read.
    """
    model = fit(docs, id_col, text_col, lang_col, path)
    out = append_language(texts_in(docs, id_col, text_col), model, keep=["doc_id"])
    return out.select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1).alias("held_out"), "lang_pred", "score")


def reject_unknown(docs: DataFrame, least_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", path: str | None = None) -> DataFrame:
    """docs without those of undetermined language, or whose best language has a posterior under least_score. Columns stay."""
    model = fit(docs, id_col, text_col, lang_col, path)
    lang, score = unused(docs, "__lang"), unused(docs, "__lang_score")
    found = append_language(docs, model, text_col, lang, score)
    return found.filter((F.col(lang) != UNDETERMINED) & (F.col(score) >= least_score)).drop(lang, score)
