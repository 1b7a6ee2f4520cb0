"""Candidate search: the best reference titles of each query by IDF-weighted Jaccard likeness of their n-grams.

Equal titles are scored once on either side. Distinct reference titles are dealt in parts of a bounded size, queries in as many
parts as keep all cores at work, and each pair of parts is a cell, a partition of one plan. A cell indexes its titles by n-gram and
streams its queries: n-grams are taken in order of falling weight until those left can't lift an unseen title into the best k;
titles seen whose bound reaches the k-th best score are verified, and the cell's best k go on.

Scores are whole millionths, worked out on integers, so neither sums nor ranks depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from titleweave.config import DEFAULT
from titleweave.functions.normalize import n_grams
from titleweave.functions.similarity import near_ratios
from titleweave.operators.frequency import SCALE, idf_weight

#: Titles of a cell, and the most parts that queries are dealt in.
CELL_TITLES, QUERY_PARTS = 50_000, 64
#: Postings that are looked through before the first guess at the k-th best score.
FIRST_LOOK = 4096
#: Characters of the n-grams that near titles are looked for by, and n-grams beyond those needed, which leave fewer to compare.
NEAR_SIZE, FURTHER = 6, 24
#: Bits for the number of a title in a cell.
OWNER = 21
#: Rows of a batch of pairs.
PAIRS = 1 << 16
#: Titles of a cell that searches many at once, of a block in it, and the least k that this is for.
WIDE_TITLES, BLOCK, MANY = 160_000, 40_000, 10
FEW = 2048  # titles whose n-grams are taken at a time
#: Nanoseconds or so to multiply and add in a product of matrices, to add a posting to a sum, and to look up an n-gram's postings.
MULTIPLY, ADD, LOOK = 0.06, 5.0, 700.0
#: A block has room for columns of the n-grams that at least this share of its titles has, but no more than MATRIX.
COMMON, MATRIX = 0.05, 400
#: Kinds that titles are told apart by, where there are so many; the n-grams that tell them, and the titles that kinds are learnt from.
KINDS, LEAST_KINDS, KIND_GRAMS, SAMPLE = 6, 20_000, 600, 4000
KIND_START = 80  # characters that tell a title's kind


@dataclass
class Index:
    titles: DataFrame  # (uid, top_id, title), one row for each distinct title
    members: DataFrame  # (uid, title_id)
    grams: np.ndarray  # n-grams as numbers, sorted; no more than the alphabet allows
    weights: np.ndarray  # of each
    size: int  # characters of an n-gram
    n: int  # titles
    distinct: int


def _uid():
    return F.xxhash64("transformed_title", F.length("transformed_title"))


def build_index(truth: DataFrame, size: int = DEFAULT.n_grams) -> Index:
    """Everything that a search needs of a reference table; it may be kept for many searches. Normalised titles are kept, as
    working them out costs more than reading them.
    """
    if size > 5:
        raise ValueError("an n-gram has 5 characters at most")
    named = truth.filter("transformed_title is not null").select("title_id", "transformed_title", _uid().alias("uid")).persist()
    distinct = named.groupBy("transformed_title", "uid").agg(F.max("title_id").alias("top_id"), F.count("*").alias("many"))
    counts = distinct.select(F.explode(n_grams(F.col("transformed_title"), size)).alias("g"), "many").groupBy("g").agg(F.sum("many").alias("df"))
    n, kinds = distinct.agg(F.coalesce(F.sum("many"), F.lit(0)), F.count("*")).first()
    found = counts.select("g", idf_weight(F.col("df"), max(n, 1)).alias("w")).toArrow()
    codes = np.array([int.from_bytes(g.encode(), "big") for g in found["g"].to_pylist()], np.int64)
    order = np.argsort(codes)
    return Index(distinct.select("uid", "top_id", F.col("transformed_title").alias("title")), named.select("uid", "title_id"), codes[order], found["w"].to_numpy()[order].astype(np.int64), size, n, kinds)


def title_grams(titles: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of normalised titles: (title, n-gram as a number), sorted."""
    data = np.frombuffer("".join(titles).encode("ascii"), np.uint8).astype(np.int64)
    lengths = np.array([len(t) for t in titles], np.int64)
    if len(data) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = sum(data[i : len(data) - size + 1 + i] << 8 * (size - 1 - i) for i in range(size))
    owner = np.repeat(np.arange(len(titles)), lengths)
    inside = owner[: len(code)] == owner[size - 1 :]
    both = np.sort((owner[: len(code)][inside] << 8 * size) | code[inside])
    both = both[np.diff(both, prepend=-1) != 0]
    return both >> 8 * size, both & ((1 << 8 * size) - 1)


def weighty_grams(titles: list[str], grams: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(title, place in grams) of the n-grams that weigh something, in small numbers; one that all titles have weighs nothing.

    Some titles at a time, as what tells them takes many times the room.
    """
    owners, of, kind = [np.zeros(0, np.int32)], [], np.uint16 if len(grams) <= 1 << 16 else np.int32
    for first in range(0, len(titles), FEW):
        owner, code = title_grams(titles[first : first + FEW], size)
        gram = np.searchsorted(grams, code)
        use = weights[gram] > 0
        owners.append((owner[use] + first).astype(np.int32))
        of.append(gram[use].astype(kind))
    return np.concatenate(owners), np.concatenate([np.zeros(0, kind), *of])


def occurrences(title: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a normalised title as numbers, sorted, and how often each occurs."""
    data = np.frombuffer(title.encode("ascii"), np.uint8).astype(np.int64)
    if len(data) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique(sum(data[i : len(data) - size + 1 + i] << 8 * (size - 1 - i) for i in range(size)), return_counts=True)


class Weights:
    """The n-grams of all reference titles and what they weigh."""

    def __init__(self, grams: np.ndarray, weights: np.ndarray, size: int):
        self.grams, self.weights, self.size = grams, weights, size
        self.heaviest = int(weights.max(initial=0))
        self.asked = np.zeros(len(grams), np.int64)

    def score(self, shared: np.ndarray, total: np.ndarray, own: int) -> np.ndarray:
        """Millionths, halves up."""
        rest = np.maximum(own + total - shared, 1)
        return (2 * SCALE * shared + rest) // (2 * rest)

    def known(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which n-grams some reference title has, and the places of those."""
        if not len(self.grams):
            return np.zeros(len(code), bool), code[:0]
        place = np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)
        there = self.grams[place] == code
        return there, place[there]

    def weight(self, code: np.ndarray) -> tuple[np.ndarray, int]:
        """The places of the n-grams that weigh something, and the weight of all; one that no title has weighs the most."""
        there, known = self.known(code)
        return known[self.weights[known] > 0], int(self.weights[known].sum()) + (len(code) - len(known)) * self.heaviest


class Cell(Weights):
    """The n-gram index of some titles, and the search of it."""

    def __init__(self, titles: list[str], top_ids: np.ndarray, grams: np.ndarray, weights: np.ndarray, size: int):
        super().__init__(grams, weights, size)
        self.titles, self.top_ids = titles, top_ids
        owner, self.gram_of = weighty_grams(titles, grams, weights, size)
        self.from_title = np.searchsorted(owner, np.arange(len(titles) + 1))
        self.total = np.bincount(owner, weights[self.gram_of], len(titles)).astype(np.int64)
        by_gram = np.argsort(self.gram_of, kind="stable")
        self.posted, self.from_gram = owner[by_gram], np.searchsorted(self.gram_of[by_gram], np.arange(len(grams) + 1))
        self.near: list[Near] = []
        self.scored = 0  # pairs worked out whole

    def add(self, sums: np.ndarray, grams: np.ndarray) -> None:
        parts = [self.posted[self.from_gram[g] : self.from_gram[g + 1]] for g in grams.tolist()]
        if parts:
            sums += np.bincount(np.concatenate(parts), np.repeat(self.weights[grams], [len(p) for p in parts]), len(sums)).astype(np.int64)

    def verify(self, titles: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """The weights that titles share with n-grams."""
        self.asked[grams] = self.weights[grams]
        sizes = self.from_title[titles + 1] - self.from_title[titles]
        filled = np.flatnonzero(sizes)
        begin = np.cumsum(sizes) - sizes
        places = np.arange(sizes.sum()) + np.repeat(self.from_title[titles] - begin, sizes)
        out = np.zeros(len(titles), np.int64)
        if len(filled):
            out[filled] = np.add.reduceat(self.asked[self.gram_of[places]], begin[filled])
        self.asked[grams] = 0
        return out

    def search(self, title: str, k: int | None, least: int = 0, slack: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The best k titles (all that share a weight where k is None) by score, then by the larger top_id; and the scores.

        least: a score; titles under it aren't wanted, which spares most of the work where it is high.
        slack: with the best k all those go that are no more than this under the k-th best score.
        """
        grams, own = self.weight(occurrences(title, self.size)[0])
        grams = grams[np.argsort(-self.weights[grams], kind="stable")]
        many = np.cumsum(self.from_gram[grams + 1] - self.from_gram[grams])
        rest = np.append(0, np.cumsum(self.weights[grams][::-1]))[::-1]  # rest[i]: the weight from the i-th on
        enough = lambda least: int(np.argmax(SCALE * rest / max(own, 1) + 1 < least)) if least > 1 else len(grams)
        sums, done = np.zeros(len(self.total), np.int64), enough(least)
        guessing = k is not None and done and many[done - 1] > FIRST_LOOK
        if guessing:
            done = min(done, int(np.searchsorted(many, FIRST_LOOK)) + 1)
        self.add(sums, grams[:done])
        seen = np.flatnonzero(sums)
        if guessing and len(seen) >= k:
            # k titles scored whole give a bound that the k-th best can't be under
            guess = seen[np.argpartition(-self.score(sums[seen], self.total[seen], own), k - 1)[:k]]
            least = max(least, int(self.score(self.verify(guess, grams), self.total[guess], own).min()) - slack)
        if (more := enough(least)) > done:
            self.add(sums, grams[done:more])
            done, seen = more, np.flatnonzero(sums)
        if done < len(grams):
            best = np.minimum(sums[seen] + rest[done], self.total[seen])
            seen = seen[self.score(best, self.total[seen], own) >= least]
            if (self.from_title[seen + 1] - self.from_title[seen]).sum() < many[-1] - (many[done - 1] if done else 0):
                sums = self.verify(seen, grams)
            else:
                self.add(sums, grams[done:])
                sums = sums[seen]
        else:
            sums = sums[seen]
        self.scored += len(seen)
        score = self.score(sums, self.total[seen], own)
        if least > 0:
            seen, score = seen[score >= least], score[score >= least]
        if k is not None:
            if len(seen) > k and (slack or len(seen) > 4 * k):
                near = score >= -np.partition(-score, k - 1)[k - 1] - slack
                seen, score = seen[near], score[near]
            order = np.lexsort((-self.top_ids[seen], -score))[: None if slack else k]
            seen, score = seen[order], score[order]
        return seen, score

    def least_near(self, titles: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Which titles have a ratio over threshold to one of the cell, and the least score of such a pair of each."""
        by_word = lambda t: " ".join(sorted(t.split(" ")))
        self.near = self.near or [Near(self.titles), Near([by_word(t) for t in self.titles])]
        share = (np.floor(threshold) + 0.5) / 100
        found = [self.near[0].alike(titles, share), self.near[1].alike([by_word(t) for t in titles], share)]
        both = np.unique(np.concatenate([q << 32 | t for q, t in found]))
        asked, rows = both >> 32, both & (1 << 32) - 1
        enough = self.near[0].with_letters(titles, asked, rows, share)
        asked, rows = asked[enough], rows[enough]
        near = near_ratios([titles[i] for i in asked.tolist()], [self.titles[i] for i in rows.tolist()], threshold) > threshold
        asked, rows = asked[near], rows[near]
        who, begin = np.unique(asked, return_index=True)
        least = np.zeros(len(who), np.int64)
        for j, (i, at, end) in enumerate(zip(who.tolist(), begin.tolist(), [*begin[1:].tolist(), len(rows)])):
            some = rows[at:end]
            grams, own = self.weight(occurrences(titles[i], self.size)[0])
            least[j] = self.score(self.verify(some, grams), self.total[some], own).min()
        return who, least


class Near:
    """Texts by their n-grams, for those that are nearly equal to another."""

    def __init__(self, texts: list[str], size: int = NEAR_SIZE):
        self.texts, self.size, self.letters = texts, size, None
        self.lengths = np.array([len(t) for t in texts], np.int64)
        code, owner, _ = self.codes(texts)
        key = np.sort(code << OWNER | owner)
        self.posted, code = (key & (1 << OWNER) - 1).astype(np.intp), key >> OWNER
        begin = np.flatnonzero(np.diff(code, prepend=-1))
        self.grams, self.from_gram = code[begin], np.append(begin, len(code))

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n-gram, text, how often), by text and n-gram."""
        data = np.frombuffer("".join(texts).encode("ascii"), np.uint8)
        if len(data) < self.size:
            return (np.zeros(0, np.int64),) * 3
        end = len(data) - self.size + 1
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        key = owner[:end].copy()
        for i in range(self.size):
            key <<= 7
            key |= data[i : end + i]
        key = key[owner[:end] == owner[self.size - 1 :]]
        key.sort()
        begin = np.flatnonzero(np.diff(key, prepend=-1))
        key, times = key[begin], np.diff(begin, append=len(key))
        return key & (1 << 7 * self.size) - 1, key >> 7 * self.size, times

    def alike(self, texts: list[str], share: float) -> tuple[np.ndarray, np.ndarray]:
        """(place in texts, place in own texts) of all whose ratio may reach share; none that does is left out.

        A letter less costs a text no more n-grams than an n-gram has letters, and a letter more costs one less. What all the
        letters that share allows can't cost must be shared, so some of a text's rarest n-grams are.
        """
        code, asked, times = self.codes(texts)
        apart, n = 1 - share + 1e-9, np.array([len(t) for t in texts], np.int64)
        less = np.arange(int(2 * apart * n.max() / (1 + apart)) + 1)
        room = 2 * apart * n[:, None] - less * (1 + apart)
        spare = np.where(room >= 0, self.size * less + (self.size - 1) * np.floor(room / max(1 - apart, 1e-9)), 0).max(1).astype(np.int64)
        place = np.minimum(np.searchsorted(self.grams, code), max(len(self.grams) - 1, 0))
        many = np.where(self.grams[place] == code, self.from_gram[place + 1] - self.from_gram[place], 0) if len(self.grams) else place
        order = np.argsort(asked << 32 | many, kind="stable")
        place, many, times = place[order], many[order], times[order]
        begin = np.searchsorted(asked, np.arange(len(texts) + 1))
        have = np.append(0, np.cumsum(times))
        have = have[1:] - have[begin[asked]]
        total = np.bincount(asked, times, len(texts)).astype(np.int64)
        needed = np.bincount(asked[have <= spare[asked]], minlength=len(texts)) + 1 + FURTHER
        chosen = (np.arange(len(asked)) - begin[asked] < needed[asked]) & (total > spare)[asked]
        place, many, times, asked = place[chosen], many[chosen], times[chosen], asked[chosen]
        most = np.bincount(asked, times, len(texts)).astype(np.int64)
        who, whom = [], []
        for i in np.flatnonzero(total <= spare).tolist():
            found = self.alike_by_letters(texts[i], share)
            who.append(np.full(len(found), i))
            whom.append(found)
        begin = np.searchsorted(asked, np.arange(len(texts) + 1)).tolist()
        start, end = self.from_gram[place].tolist(), (self.from_gram[place] + many).tolist()
        for i in np.flatnonzero(np.bincount(asked, many, len(texts))).tolist():
            some = slice(begin[i], begin[i + 1])
            owners = np.concatenate([self.posted[a:b] for a, b in zip(start[some], end[some], strict=True)])
            often = times[some]
            shared = np.bincount(owners, None if often.max() == 1 else np.repeat(often, many[some]))
            found = np.flatnonzero(shared >= most[i] - spare[i])
            who.append(np.full(len(found), i))
            whom.append(found)
            both = np.floor(apart * (n[i] + self.lengths[found]))  # letters less and more
            longer = n[i] - self.lengths[found]
            fits = (both >= np.abs(longer)) & (shared[found] >= most[i] - (self.size * (both + longer) + (self.size - 1) * (both - longer)) / 2)
            who[-1], whom[-1] = who[-1][fits], found[fits]
        return (np.concatenate(who), np.concatenate(whom)) if who else (place[:0], place[:0])

    def count_letters(self) -> np.ndarray:
        """How often each text has each letter."""
        if self.letters is None:
            data = np.frombuffer("".join(self.texts).encode("ascii"), np.uint8)
            places = np.repeat(np.arange(len(self.texts)) * 128, self.lengths)
            self.letters = np.bincount(places + data, minlength=128 * len(self.texts)).astype(np.int32).reshape(-1, 128)
        return self.letters

    def alike_by_letters(self, text: str, share: float) -> np.ndarray:
        """alike() of one text that is too short, or a share too low, for n-grams: by how often each letter occurs."""
        own = _letters(text)
        used = np.flatnonzero(own)
        common = np.minimum(self.count_letters()[:, used], own[used]).sum(1)
        return np.flatnonzero(2 * common >= (share - 1e-9) * (len(text) + self.lengths))

    def with_letters(self, texts: list[str], asked: np.ndarray, found: np.ndarray, share: float) -> np.ndarray:
        """Which pairs of texts[asked] and own texts[found] have letters enough in common."""
        own, out = np.array([_letters(t) for t in texts]), np.zeros(len(asked), bool)
        n = np.array([len(t) for t in texts], np.int64)
        for at in range(0, len(asked), 1 << 14):
            q, t = asked[at : at + (1 << 14)], found[at : at + (1 << 14)]
            out[at : at + len(q)] = 2 * np.minimum(own[q], self.count_letters()[t]).sum(1) >= (share - 1e-9) * (n[q] + self.lengths[t])
        return out


def _letters(text: str) -> np.ndarray:
    return np.bincount(np.frombuffer(text.encode("ascii"), np.uint8), minlength=128)


class Block:
    """Some titles of a WideCell: which of them have each n-gram."""

    def __init__(self, titles: list[str], grams: np.ndarray, weights: np.ndarray, size: int):
        n = len(titles)
        owner, self.gram_of = weighty_grams(titles, grams, weights, size)
        self.from_title = np.searchsorted(owner, np.arange(n + 1))
        self.total = np.bincount(owner, weights[self.gram_of], n).astype(np.int64)
        self.near_total = self.total.astype(np.float32)
        self.many = np.bincount(self.gram_of, minlength=len(grams))
        self.from_gram = np.append(0, np.cumsum(self.many))
        self.posted = owner[np.argsort(self.gram_of, kind="stable")].astype(np.uint16 if n <= 1 << 16 else np.int32)


def kinds_of(titles: list[str], grams: np.ndarray, weights: np.ndarray, size: int, most: int) -> np.ndarray:
    """A row for each n-gram, a column for each of some kinds of titles: those of a kind, of a language say, tend to share n-grams. Nothing
    but time depends on it.
    """
    few = titles[:: max(1, len(titles) // SAMPLE)]
    owner, gram = weighty_grams(few, grams, weights, size)
    used = np.sort(np.argsort(-np.bincount(gram, minlength=len(grams)), kind="stable")[:KIND_GRAMS])
    at = np.full(len(grams), -1)
    at[used] = np.arange(len(used))
    rows = np.zeros((len(few), len(used)), np.float32)
    rows[owner[at[gram] >= 0], at[gram[at[gram] >= 0]]] = 1
    rows /= np.maximum(np.sqrt(rows.sum(1, keepdims=True)), 1)
    centre = rows.mean(0)
    middles = [rows[np.argmax(rows @ centre)]]
    while len(middles) < most:  # each next one far from those before, but not from all titles
        nearest = (rows @ np.array(middles).T).max(1)
        middles.append(rows[np.argmax(rows @ centre - nearest)])
    middles = np.array(middles)
    for _ in range(8):
        of = (rows @ middles.T).argmax(1)
        middles = np.array([rows[of == j].mean(0) if (of == j).any() else middles[j] for j in range(most)])
        middles /= np.maximum(np.sqrt((middles**2).sum(1, keepdims=True)), 1e-6)
    wide = np.zeros((len(grams), most), np.float32)
    wide[used] = middles.T
    return wide


class WideCell(Weights):
    """The best k of many titles for many queries at once. Weights that a query shares with all titles of a block are summed in
    single precision, those of n-grams common in both by a product of matrices; whatever may be among the best k, by the error that
    such sums can have, is scored again on integers.

    Titles are dealt in blocks by their kind, and so are queries in batches: n-grams of one language are common in few blocks. Once
    k titles are known, a column of weights under their worst score is part of the product, so that one look tells what is better.
    """

    def __init__(self, titles: list[str], top_ids: np.ndarray, grams: np.ndarray, weights: np.ndarray, size: int):
        super().__init__(grams, weights, size)
        self.kinds, self.order, ends = None, np.arange(len(titles)), [len(titles)]
        if len(titles) >= LEAST_KINDS:
            self.kinds = kinds_of(titles, grams, weights, size, KINDS)
            of = self.kind_of(titles)
            self.order = np.argsort(of, kind="stable")
            ends = np.cumsum(np.bincount(of, minlength=KINDS)).tolist()
        self.top_ids = top_ids[self.order]
        begins = [0]
        for end in ends:  # blocks of one kind, but for kinds that have few titles
            while end - begins[-1] > BLOCK:
                begins.append(begins[-1] + -(-(end - begins[-1]) // -(-(end - begins[-1]) // BLOCK)))
            if end - begins[-1] >= BLOCK // 8 or end == len(titles) > begins[-1]:
                begins.append(end)
        parts = [self.order[a:b].tolist() for a, b in zip(begins, begins[1:], strict=False)]
        self.blocks = [Block([titles[i] for i in part], grams, weights, size) for part in parts]
        self.total = np.concatenate([np.zeros(0, np.int64), *[b.total for b in self.blocks]])
        begin = np.cumsum([0, *[len(b.gram_of) for b in self.blocks]])
        self.from_title = np.concatenate([*[b.from_title[:-1] + at for b, at in zip(self.blocks, begin.tolist(), strict=False)], begin[-1:]])
        self.gram_of = np.concatenate([np.zeros(0, np.uint16), *[b.__dict__.pop("gram_of") for b in self.blocks]])
        self.column = np.full(len(grams), -1, np.int32)
        common = max([0, *[int((b.many > COMMON * len(b.total)).sum()) for b in self.blocks]])
        self.wide = np.empty((max([0, *[len(p) for p in parts]]), min(common, MATRIX, max(len(grams) - 2, 0)) + 1), np.float32, order="F")

    def kind_of(self, titles: list[str]) -> np.ndarray:
        out = [np.zeros(0, np.int64)]
        for first in range(0, len(titles), FEW):
            owner, code = title_grams([t[:KIND_START] for t in titles[first : first + FEW]], self.size)
            there, place = self.known(code)
            owner, most = owner[there], min(FEW, len(titles) - first)
            out.append(np.array([np.bincount(owner, self.kinds[place, j], most) for j in range(self.kinds.shape[1])]).argmax(0))
        return np.concatenate(out)

    def sorted(self, titles: list[str]) -> np.ndarray:
        """The places of queries, so that those of a kind are searched together."""
        return np.arange(len(titles)) if self.kinds is None else np.argsort(self.kind_of(titles), kind="stable")

    def search(self, titles: list[str], k: int, slack: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
        """Cell.search() of each title."""
        asked = [self.weight(occurrences(t, self.size)[0]) for t in titles]
        sizes = np.array([len(grams) for grams, _ in asked])
        gram, of = np.concatenate([np.zeros(0, np.int64), *[grams for grams, _ in asked]]), np.repeat(np.arange(len(titles)), sizes)
        many = np.bincount(gram, minlength=len(self.grams))
        sums = np.empty((len(titles), len(self.wide)), np.float32)
        found = [Best(k, slack, own, len(grams)) for grams, own in asked]
        first = np.cumsum([0, *[len(b.total) for b in self.blocks]]).tolist()
        alike = [-float((many * self.weights) @ b.many) / len(b.total) for b in self.blocks]
        for at in np.argsort(alike, kind="stable").tolist():
            block = self.blocks[at]
            shared, begin, end, from_query = self.shared(block, gram, of, many, found, sums)
            for i, best in enumerate(found):
                some = slice(from_query[i], from_query[i + 1])
                places = [block.posted[a:b] for a, b in zip(begin[some].tolist(), end[some].tolist(), strict=True)]
                if places:
                    rare = self.rare[some]
                    np.add.at(shared[i], np.concatenate(places).astype(np.intp), np.repeat(rare, end[some] - begin[some]))
                best.add(block, shared[i], first[at], self.possible)
        return [self.whole(best, grams) for best, (grams, _) in zip(found, asked, strict=True)]

    def shared(self, block: Block, gram: np.ndarray, of: np.ndarray, many: np.ndarray, found: list[Best], sums: np.ndarray) -> tuple:
        """The weights that queries share with the titles of a block, of n-grams that enough of both have, less what their worst
        title's score takes; and the postings of the other n-grams by query.
        """
        n, q = len(block.total), len(found)
        gain = many * (block.many * ADD + LOOK) - MULTIPLY * q * n
        common = np.flatnonzero((gain > 0) & (block.many > 0))
        if len(common) >= self.wide.shape[1]:
            common = common[np.argsort(-gain[common], kind="stable")[: self.wide.shape[1] - 1]]
        d = len(common)
        self.column[common] = np.arange(d)
        at = self.column[gram]
        self.column[common] = -1
        rows, wide, dense = np.zeros((q, d + 1), np.float32), self.wide[:n, : d + 1], at >= 0
        rows[of[dense], at[dense]] = self.weights[gram[dense]]
        rows[:, d] = [-best.part for best in found]
        wide[:, :d] = 0
        for j, (a, b) in enumerate(zip(block.from_gram[common].tolist(), block.from_gram[common + 1].tolist(), strict=True)):
            wide[:, j][block.posted[a:b]] = 1
        wide[:, d] = block.near_total
        shared = np.matmul(rows, wide.T, out=sums[:, :n] if n == sums.shape[1] else None)
        rare, of = gram[~dense], of[~dense]
        there = block.many[rare] > 0
        rare, of = rare[there], of[there]
        self.rare = self.weights[rare].astype(np.float32)
        return shared, block.from_gram[rare], block.from_gram[rare + 1], np.searchsorted(of, np.arange(q + 1)).tolist()

    def possible(self, near: np.ndarray, k: int, slack: int, grams: int) -> np.ndarray:
        """Titles of a block that may be among the best k, or no more than slack under them; near: their scores in single precision."""
        groups, least = min(6 * k, len(near)), 0.0
        if groups >= k:  # k groups have a title each that is no worse than the k-th best group's best
            tops = near[: len(near) // groups * groups].reshape(-1, groups).max(0)
            least = float(np.partition(tops, groups - k)[groups - k])
        least -= (grams + 16) * 2.0**-21 * least + (2 + slack) / SCALE
        return np.flatnonzero(near >= least if least > 0 else near > 0)

    def whole(self, best: Best, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best k of those that were possible, scored on integers."""
        titles = best.left()
        if not len(titles):
            return titles, np.zeros(0, np.int64)
        self.asked[grams] = self.weights[grams]
        start = self.from_title[titles]
        sizes = self.from_title[titles + 1] - start
        begin = np.cumsum(sizes) - sizes
        shared = np.add.reduceat(self.asked[self.gram_of[np.arange(sizes.sum()) + np.repeat(start - begin, sizes)]], begin)
        self.asked[grams] = 0
        rows, score, _ = best_of(titles, self.score(shared, self.total[titles], best.own), self.top_ids[titles], best.k, best.slack)
        return self.order[rows], score


class Best:
    """What may be among the best k titles of a query, as far as blocks have been looked through."""

    def __init__(self, k: int, slack: int, own: int, grams: int):
        self.k, self.slack, self.own, self.grams = k, slack, own, grams
        self.least = self.part = 0.0  # the k-th best score is no less, and what a title must share of its own weight and the query's
        self.rows, self.low, self.high = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

    def add(self, block: Block, shared: np.ndarray, first: int, possible: Callable) -> None:
        """shared: of each title of a block what it shares with the query, less part of its weight; in single precision."""
        error = (self.grams + 8) * 2.0**-23 * (self.own + self.part * float(block.total.max(initial=0)))
        if self.part:
            some = np.flatnonzero(shared >= self.part * self.own - error)
        else:
            rest = block.near_total + np.float32(self.own)
            rest -= shared
            np.maximum(rest, 1, out=rest)
            some = possible(np.divide(shared, rest, out=rest), self.k, self.slack, self.grams)
        if not len(some):
            return
        total = block.total[some]
        sure = shared[some] + self.part * total
        both = self.own + total
        self.rows = np.concatenate([self.rows, some + first])
        self.low = np.concatenate([self.low, (sure - error) / np.maximum(both - sure + error, 1)])
        self.high = np.concatenate([self.high, (sure + error) / np.maximum(both - sure - error, 1)])
        if len(self.low) >= self.k:
            self.least = max(self.least, float(np.partition(self.low, len(self.low) - self.k)[len(self.low) - self.k]) - (2 + self.slack) / SCALE)
            self.part = self.least / (1 + self.least)
            if len(self.rows) > 2 * self.k:
                kept = self.high >= self.least
                self.rows, self.low, self.high = self.rows[kept], self.low[kept], self.high[kept]

    def left(self) -> np.ndarray:
        return self.rows[self.high >= self.least]


def best_of(rows: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k by score, then by the larger id; with slack all that are no more than that under the k-th best score."""
    if len(rows) > k and slack:
        near = score >= -np.partition(-score, k - 1)[k - 1] - slack
        rows, score, ids = rows[near], score[near], ids[near]
    order = np.lexsort((-ids, -score))[: None if slack else k]
    return rows[order], score[order], ids[order]


def _cells(queries: DataFrame, index: Index, answer: Callable[[Cell, pa.Table, pa.RecordBatch], Iterator[list]], schema: str, kind: type = Cell, most: int = 0) -> DataFrame:
    """What answer() makes of the queries(qid, title, ...) of each cell, some at a time, and the cell's reference rows."""
    spark = queries.sparkSession
    parts = max(1, -(-index.distinct // (most or CELL_TITLES)))
    columns = min(QUERY_PARTS, max(1, -(-2 * spark.sparkContext.defaultParallelism // parts)))
    told = spark.sparkContext.broadcast((index.grams, index.weights))
    size, names = index.size, [x.split(" ")[0] for x in schema.split(", ")]
    part, column = F.pmod(F.xxhash64("uid", F.lit("part")), F.lit(parts)), F.pmod(F.xxhash64("qid", F.lit("column")), F.lit(columns))
    reference = index.titles.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: (part * columns + c).cast("int"))).alias("cell"), F.lit(0).alias("kind"), F.col("uid").alias("id"), F.col("top_id").alias("number"), *index.titles.columns[2:])
    asked = queries.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: (column + columns * p).cast("int"))).alias("cell"), F.lit(1).alias("kind"), F.col("qid").alias("id"), (F.col("least") if "least" in queries.columns else F.lit(0).cast("long")).alias("number"), *[c for c in queries.columns if c not in ("qid", "least")])
    dealt = reference.unionByName(asked).repartitionById(parts * columns, F.col("cell")).sortWithinPartitions("kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, cell = [], None
        for whole in batches:
            first = int(np.searchsorted(whole.column(1).to_numpy(), 1))
            if first:
                rows.append(whole.slice(0, first))
            if first == len(whole) or not rows:
                continue
            if cell is None:
                held = pa.Table.from_batches(rows).combine_chunks()
                rows = [held]
                cell = kind(held["title"].to_pylist(), held["number"].to_numpy(), *told.value, size)
            asked = whole.slice(first)
            if kind is WideCell:
                asked = asked.take(pa.array(cell.sorted(asked.column("title").to_pylist())))
            for at in range(0, len(asked), 256):
                for made in answer(cell, held, asked.slice(at, 256)):
                    yield pa.RecordBatch.from_arrays(made, names=names)

    return dealt.mapInArrow(run, schema)


def _best(queries: DataFrame, index: Index, k: int, slack: int = 0) -> DataFrame:
    """(qid, title, uid, top_id, match, score) of distinct titles; of queries(qid, title) and least, where it is there: see
    Cell.search(). Best k of each query and part.
    """

    def answer(cell: Cell, held: pa.Table, some: pa.RecordBatch) -> Iterator[list]:
        found = [cell.search(t, k, least, slack) for t, least in zip(some.column("title").to_pylist(), some.column("number").to_pylist(), strict=True)]
        rows, score = np.concatenate([x for x, _ in found]), np.concatenate([s for _, s in found])
        asked = pa.array(np.repeat(np.arange(len(some)), [len(x) for x, _ in found]))
        mine = [held[c].chunk(0).take(pa.array(rows)) for c in ("id", "number", "title")]
        yield [some.column("id").take(asked), some.column("title").take(asked), *mine, pa.array(score / SCALE)]

    return _cells(queries, index, answer, "qid long, title string, uid long, top_id long, match string, score double")


def _asked(queries: DataFrame) -> DataFrame:
    """The queries that have a title, kept: they are read twice and may be dear to work out."""
    return queries.filter("transformed_title is not null").select("test_index", "transformed_title").persist()


def _named(queries: DataFrame) -> DataFrame:
    return queries.filter("transformed_title is not null").select("test_index", _uid().alias("qid"))


def _distinct(queries: DataFrame) -> DataFrame:
    return queries.filter("transformed_title is not null").select(_uid().alias("qid"), F.col("transformed_title").alias("title")).distinct()


def _asked_rows(queries: DataFrame) -> DataFrame:
    """(qid, title, rows): distinct titles and the test rows of each."""
    named = queries.filter("transformed_title is not null").select(_uid().alias("qid"), F.col("transformed_title").alias("title"), F.col("test_index").cast("long").alias("test_index"))
    return named.groupBy("qid", "title").agg(F.collect_list("test_index").alias("rows"))


def jaccard_scores(queries: DataFrame, index: Index) -> DataFrame:
    """(test_index, title_id, score) of every pair that shares an n-gram with weight. Cells know the rows of each title, so
    that pairs come out of them as they are, a bounded number at a time, and are neither joined nor shuffled.
    """
    rows = index.members.groupBy("uid").agg(F.collect_list("title_id").alias("rows"))

    def answer(cell: Cell, held: pa.Table, some: pa.RecordBatch) -> Iterator[list]:
        lists = held["rows"].chunk(0)
        ids, begin = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for title, own in zip(some.column("title").to_pylist(), some.column("rows").to_pylist(), strict=True):
            found, score = cell.search(title, None)
            sizes = begin[found + 1] - begin[found]
            before = np.cumsum(sizes) - sizes
            places = np.arange(sizes.sum()) + np.repeat(begin[found] - before, sizes)
            title_ids, scores = ids[places], np.repeat(score / SCALE, sizes)
            for test_index in own:
                for at in range(0, len(places), PAIRS):
                    some_ids = title_ids[at : at + PAIRS]
                    yield [pa.array(np.full(len(some_ids), test_index, np.int64)), pa.array(some_ids), pa.array(scores[at : at + PAIRS])]

    return _cells(_asked_rows(queries), replace(index, titles=index.titles.join(rows, "uid").select("uid", "top_id", "title", "rows")), answer, "test_index long, title_id long, score double")


def closest_pairs(queries: DataFrame, index: Index, k: int = DEFAULT.top_n_predicting) -> DataFrame:
    """(test_index, title_id, title, match, score, rn): the best k by score, then by the larger title_id, with both
    normalised titles; fewer where fewer share anything.

    The best k rows lie within the best k distinct titles, ranked by score and by their largest title_id, and within the k
    largest title_ids of each.
    """
    return _closest(queries, index, k, True)


def _closest(queries: DataFrame, index: Index, k: int, titles: bool) -> DataFrame:
    """closest_pairs(), with both titles or without. Cells know the rows of each title, on either side, and rank them; only
    where there are several parts of reference titles are their ranks put together.
    """
    kind, most = (WideCell, WIDE_TITLES) if k >= MANY else (Cell, CELL_TITLES)
    last = index.members.groupBy("uid").agg(F.slice(F.sort_array(F.collect_list("title_id"), False), 1, k).alias("rows"))

    def answer(cell: Cell | WideCell, held: pa.Table, some: pa.RecordBatch) -> Iterator[list]:
        lists, asked, texts = held["rows"].chunk(0), some.column("rows"), some.column("title").to_pylist()
        ids, begin = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        found = cell.search(texts, k) if isinstance(cell, WideCell) else [cell.search(t, k) for t in texts]
        made, many = [], 0

        def told() -> list:
            own, title_ids, place, score, text, row = (np.concatenate(x) for x in zip(*made, strict=True))
            both = [some.column("title").take(pa.array(text)), held["title"].chunk(0).take(pa.array(row))] if titles else []
            return [pa.array(own), pa.array(title_ids), *both, pa.array(score / SCALE), pa.array(place)]

        for i, (rows, score) in enumerate(found):
            sizes = begin[rows + 1] - begin[rows]
            places = np.arange(sizes.sum()) + np.repeat(begin[rows] - (np.cumsum(sizes) - sizes), sizes)
            title_ids, score, row = ids[places], np.repeat(score, sizes), np.repeat(rows, sizes)
            best = np.lexsort((-title_ids, -score))[:k]
            own = asked[i].values.to_numpy()
            for at in range(0, len(own) if len(best) else 0, max(1, PAIRS // k)):
                part = own[at : at + max(1, PAIRS // k)]
                again = np.tile(best, len(part))
                made.append((np.repeat(part, len(best)), title_ids[again], np.tile(np.arange(1, len(best) + 1, dtype=np.int32), len(part)), score[again], np.full(len(again), i), row[again]))
                many += len(again)
                if many >= PAIRS:
                    yield told()
                    made, many = [], 0
        if made:
            yield told()

    both = "title string, match string, " if titles else ""
    known = replace(index, titles=index.titles.join(last, "uid").select("uid", "top_id", "title", "rows"))
    out = _cells(_asked_rows(queries), known, answer, f"test_index long, title_id long, {both}score double, rn int", kind, most)
    if index.distinct > most:
        order = Window.partitionBy("test_index").orderBy(F.col("score").desc(), F.col("title_id").desc())
        out = out.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)
    return out


def _last_members(index: Index, k: int) -> DataFrame:
    last = Window.partitionBy("uid").orderBy(F.col("title_id").desc())
    return index.members.withColumn("place", F.row_number().over(last)).filter(F.col("place") <= k).drop("place")


def _ranked(distinct: DataFrame, index: Index, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("title_id").desc())
    return _best(distinct, index, k).join(_last_members(index, k), "uid").withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)


def near_pairs(queries: DataFrame, index: Index, k: int = DEFAULT.top_n_predicting, threshold: float = DEFAULT.ratio_threshold) -> DataFrame:
    """Those rows of closest_pairs() that score no less than the query's worst pair with a ratio over threshold, so all that the
    near-exact stage can match; none of a query without such a pair.

    Titles with such a ratio are found first, by the n-grams that it leaves them no room to differ in. Their score is a bound
    for the search that tells which of them are among the best k.
    """
    kept = _asked(queries)

    def answer(cell: Cell, held: pa.Table, some: pa.RecordBatch) -> Iterator[list]:
        who, least = cell.least_near(some.column("title").to_pylist(), threshold)
        yield [c.take(pa.array(who)) for c in (some.column("id"), some.column("title"))] + [pa.array(least)]

    found = _cells(_distinct(kept), index, answer, "qid long, title string, least long")
    bound = found.groupBy("qid", "title").agg(F.min("least").alias("least"))
    return _named(kept).join(_ranked(bound, index, k), "qid").select("test_index", "title_id", "title", "match", "score", "rn")


def closest_matches(queries: DataFrame, index: Index, k: int = DEFAULT.top_n_predicting) -> DataFrame:
    """(test_index, title_id, score, rn): see closest_pairs."""
    return _closest(queries, index, k, False)


def closest_matches_positional(queries: DataFrame, index: Index, k: int = DEFAULT.top_n_predicting, slack: float = 1 / SCALE) -> DataFrame:
    """The same number of rows by another rule: of those within slack of the k-th best score, the k with the largest title_id."""
    asked = _asked(queries)
    found = _best(_distinct(asked), index, k, int(np.ceil(slack * SCALE)) + 1)
    scores = _named(asked).join(found.join(_last_members(index, k), "uid"), "qid").select("test_index", "title_id", "score")
    by_score = Window.partitionBy("test_index").orderBy(F.col("score").desc())
    by_place = Window.partitionBy("test_index").orderBy(F.col("title_id").desc())
    placed = scores.withColumn("__r", F.row_number().over(by_score))
    told = placed.withColumn("__kth", F.min(F.when(F.col("__r") <= k, F.col("score"))).over(Window.partitionBy("test_index")))
    near = told.filter(F.col("score") >= F.col("__kth") - slack)
    return near.withColumn("rn", F.row_number().over(by_place)).filter(F.col("rn") <= k).select("test_index", "title_id", "score", "rn")
