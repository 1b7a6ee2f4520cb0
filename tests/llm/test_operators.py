"""The text operators against brute force, on texts with every awkward case."""

import hashlib
import random
import time
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from titleweave.llm import bpe, chat, decontam, langid, linededup, rangecoder, simhash, substring, tokenfile, toxicity, winnow
from titleweave.llm.common import append_columns

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, component_id int, score string, hits int, items string, n_words string, ids int, marks int, kept int, __gone int, key int"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(20))


def make(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "x", 1, "s", 2, "i", "n", 3, 4, 5, 6, 7) for i, t in rows], SCHEMA)


def awkward():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 4)))
    some = [" ".join(word() for _ in range(r.randint(1, 60))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(some)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "!!! ???"), (104, "one"), (105, "one two"), (None, some[3]), (None, None)]
    rows += [(110, some[0]), (111, some[0].upper()), (112, some[1] + " tail"), (112, some[1] + " tail"), (113, some[2]), (113, some[4])]
    rows += [(120, "before " + PASSAGE + " after"), (121, PASSAGE), (122, "x " + PASSAGE), (123, PASSAGE + " " + PASSAGE), (130, LONG), (131, LONG + " end"), (132, "a" * 50_000)]
    rows += [(140, "same line\nother line\nthird"), (141, "new\nsame line\n \nother line\nlast"), (142, "same line\nother line"), (143, "\n\n\n"), (144, "same line\r\nother line")]
    rows += [(150, "naïve “quoted” 北京 é \U0001f600 <|endoftext|> '’s it's"), (151, "İstanbul ΣΑΣ \x85 x")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, awkward()).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, awkward()[:1]).limit(0)


def text_of(t):
    return "" if t is None else t


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def ascii_words(t):
    return text_of(t).encode().split()


# 1 near duplicates


def brute_simhash(t):
    words = ascii_words(ascii_lower(text_of(t)))
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    out = []
    for i in range(len(fps)):
        own = [ids[j] for j in range(len(fps)) if find(j) == find(i) and ids[j] is not None]
        out.append(min(own) if own else None)
    return out


def test_near_duplicates(docs, empty):
    rows = awkward()
    fps = [brute_simhash(t) for _, t in rows]
    want = [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, brute_components(fps, [i for i, _ in rows]), strict=True)]
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted([str(x) for x in {c for i, _, c in want if i is not None}] + ["None", "None"])


def test_unlike_texts_of_one_id_stay(spark):
    rows = [(7, PASSAGE), (7, LONG), (7, LONG), (8, PASSAGE + " more"), (9, LONG), (None, LONG)]
    kept = simhash.keep_one(make(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept if r["text"] == LONG) == [("7", LONG), ("None", LONG)]
    assert (7, PASSAGE) in {(r["doc_id"], r["text"]) for r in kept}


@pytest.mark.parametrize("cell_limit", [1, 8, 10_000])
def test_links_connect_what_brute_force_does(spark, cell_limit):
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base[:6]:  # crowded places: many within a few bits
        for _ in range(60):
            x = b
            for _ in range(r.randint(1, 4)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = [tuple(e) for e in simhash.links(df, len(fps), simhash.bit_counts(df), cell_limit).collect()]
    assert all(((u ^ v) & (2**64 - 1)).bit_count() <= 2 for u, v in edges)
    from titleweave.llm.components import components

    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = brute_components(fps, signed)
    assert [got.get(x, x) for x in signed] == want


def test_few_edges_are_joined_in_one_task(spark, monkeypatch):
    """A chain takes several rounds of shuffles over all partitions, each of them plans and tasks that the driver holds."""
    from titleweave.llm import components as c

    r = random.Random(5)
    nodes = [r.getrandbits(64) - 2**63 for _ in range(300)]
    chains = [nodes[:200], nodes[200:290], nodes[290:], [7, 7]]
    edges = [e for chain in chains for e in zip(chain, chain[1:], strict=False)]
    r.shuffle(edges)
    made, materialize = [], c.materialize
    monkeypatch.setattr(c, "materialize", lambda df, label: made.append(label) or materialize(df, label))
    df = spark.createDataFrame(edges, "u long, v long")
    want = {n: min(chain) for chain in chains[:3] for n in chain}
    assert {(x["node"], x["root"]) for x in c.components(df).collect()} == set(want.items())
    assert len(made) == 2
    assert c.components(df.filter("false")).collect() == []
    monkeypatch.setattr(c, "FEW_EDGES", -1)
    assert {(x["node"], x["root"]) for x in c.components(df).collect()} == set(want.items())
    assert c.components(df.filter("false")).collect() == []


def test_thresholds_sum_and_cost():
    r = np.random.default_rng(1)
    fps = r.integers(0, 1 << 63, 50).astype(np.uint64)
    for m in (2, 3, 4):
        parts = [list(range(64))[k::m] for k in range(m)]
        t = simhash.allocate(r.integers(1, 1000, (50, m)).astype(float), fps, parts, np.full(64, 0.5), 10_000)
        assert (t.sum(1) == simhash.RADIUS - m + 1).all() and t.min() >= -1


# 2 token output


def test_range_coder_round_trip_and_checksums():
    r = np.random.default_rng(2)
    for ids in (np.zeros(0, int), np.array([65535]), r.integers(0, 65536, 9000), np.tile(np.arange(7), 1500), np.minimum(r.geometric(0.01, 12_289), 60000)):
        blob = rangecoder.compress(ids)
        assert (rangecoder.decompress(blob) == ids).all()
    assert len(rangecoder.compress(np.tile(np.arange(7), 1500))) < 2000
    bad = bytearray(blob)
    bad[-40] ^= 1
    with pytest.raises(ValueError):
        rangecoder.decompress(bytes(bad))
    with pytest.raises(ValueError):
        rangecoder.compress(np.array([70_000]))


def test_range_coder_learns_across_blocks_and_is_quick():
    r = np.random.default_rng(3)
    ids = r.permutation(5000)[np.minimum(r.geometric(0.002, 400_000), 4999)]
    ids[200_000:] = np.tile(ids[:2_000], 100)  # stretches that come in other blocks again
    before = time.process_time()
    blob = rangecoder.compress(ids)
    assert (rangecoder.decompress(blob) == ids).all()
    assert time.process_time() - before < 3  # CPU seconds; with tables of each block's own it took 11.8
    assert len(blob) < 400_000
    for at in (-1, -2, len(blob) // 2, 30):
        bad = bytearray(blob)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            rangecoder.decompress(bytes(bad))
    with pytest.raises(ValueError):
        rangecoder.decompress(blob[:-9])


@pytest.mark.parametrize("cache", [10, 100_000])
def test_words_are_those_of_the_library(monkeypatch, cache):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfile, "CACHE_SIZE", cache)
    with open(tokenfile.default_vocabulary(), encoding="utf-8") as f:
        told = f.read()
    t, words, r = Tokenizer.from_str(told), tokenfile.Words(told), random.Random(4)
    bits = ["The", "the.", "THE!?", "don't", "'s.", "x'LL,", "<|endoftext|>", "<|ENDOFTEXT|>.", "a<|endoftext|>b", "e.g.", "1st.", "a-1", "É", "É!", "naïve,", "E\u0301.", "\u0130.", "ΣΑΣ.", "中.", "ª.", "a\x1cb", "\x85", "\u3000x", "a\u0338", "a=\u0338", "<", "a<b", "!" * 70, "ab" + "!" * 70, "A" * 70 + ".", "q" * 3000]
    texts = [None, "", " ", " a ", *("".join(r.choice(bits) + r.choice([" ", "\n", "\t ", "\x0b", "\x0c", ""]) for _ in range(12)) for _ in range(400))]
    for k in range(0, len(texts), 101):
        some = texts[k : k + 101]
        ids, sizes = words.encode(pa.array(some, pa.string()), [2])
        got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == [t.encode(x or "", add_special_tokens=False).ids + [2] for x in some]
        assert len(words.starts) == len(words.rows) + 1 and not any(len(w) > tokenfile.CACHED for w in words.rows)


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenfile.default_vocabulary())
    rows = sorted(awkward(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for i, text in rows:
        ids = t.encode(text_of(text), add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in tokenfile.write_and_read(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert tokenfile.write_and_read(empty).count() == 0


# 3 substrings


def brute_substrings(rows, n=13):
    first = {}
    least = lambda i: (i is not None, i or 0)
    for i, t in rows:
        w = ascii_words(t)
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            first[g] = min(first.get(g, least(i)), least(i))
    out = []
    for i, t in rows:
        w = ascii_words(t)
        gone = {k + j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < least(i) for j in range(n)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1000, 1])
def test_substring_dedup(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT_SEGMENTS", hot)
    got = [tuple(r) for r in substring.report(docs).collect()]
    assert sorted(got, key=str) == sorted(brute_substrings(awkward()), key=str)
    assert substring.report(empty).count() == 0
    kept = {r["doc_id"]: r["kept"] for r in substring.remove_repeats(docs).collect()}
    assert kept[122] == "x" and kept[121] == ""


def test_substring_dedup_on_random_repeats(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 80)))) for i in range(60)]
    got = [tuple(r) for r in substring.report(make(spark, rows)).collect()]
    assert sorted(got) == sorted(brute_substrings(rows))


def test_word_hashes():
    from titleweave.llm.segments import CHUNK, LONG, word_hashes

    texts = [b"a" * CHUNK + b" b " + b"c" * LONG + b"\x0b" + b"c" * (LONG + 1), None, b"", b" \x0c ", b"b\x00 \x00b b", b"x yx " * CHUNK, b"a" * CHUNK, b"ab ba " + "\u00e9 x\u00a0y".encode()]
    words = [w for x in texts for w in (x or b"").split()]
    found, ends = word_hashes(texts)
    assert ends.tolist() == np.cumsum([len((x or b"").split()) for x in texts]).tolist()
    assert len(found) == len(words) and len(set(found.tolist())) == len(set(words)) == len(set(zip(words, found.tolist(), strict=True)))
    assert [len(x) for x in word_hashes([])] == [0, 0]


@pytest.mark.parametrize("depth", [1, 2, 5, 13])
def test_fm_index_gives_matching_statistics(depth):
    from titleweave.llm.fmindex import FMIndex

    r = np.random.default_rng(3)
    for letters in (2, 4):
        text = np.append(r.integers(0, letters, 400), 0)
        index = FMIndex(text, letters, depth)
        ring = np.concatenate([text, text])
        stretch = lambda k: tuple(ring[k : k + depth])
        assert [stretch(k) for k in index.order] == sorted(stretch(k) for k in range(len(text)))
        members = {}
        for k, c in zip(index.order, index.classes, strict=True):
            members.setdefault(c, set()).add(k)
        streams = [r.integers(0, letters, n) for n in (0, 1, depth - 1, depth, 40, 90)] + [text[50:120], np.concatenate([text[7:60], text[3:90], r.integers(0, letters, 20)])]
        flat, size = np.concatenate(streams), np.array([len(x) for x in streams])
        begin = np.cumsum(size) - size
        got = index.stream(flat, begin, size)
        for x, b in zip(streams, begin, strict=True):
            for i in range(len(x)):
                places = {k for k in range(len(text)) if stretch(k) == tuple(x[i : i + depth])} if i + depth <= len(x) else set()
                assert members.get(got[b + i], set()) == places


def test_substring_dedup_depends_on_the_index(spark, monkeypatch):
    from titleweave.llm.fmindex import FMIndex

    rows = [(1, PASSAGE), (2, "x " + PASSAGE), (3, LONG), (4, LONG)]
    assert sum(r["n_removed"] for r in substring.report(make(spark, rows)).collect()) == 20 + 30_000
    one = spark.createDataFrame([(1, 2, 20 - 12, False, 1, 2, PASSAGE.encode())], "key long, content long, n int, hot boolean, id long, most long, words binary").toArrow()
    assert substring._owners(one).num_rows == 1
    monkeypatch.setattr(FMIndex, "stream", lambda self, texts, begin, size: np.full(len(texts), -1))
    assert substring._owners(one).num_rows == 0


def test_long_segments_are_cut():
    from titleweave.llm.segments import MOST, cut, word_hashes

    h, ends = word_hashes([b"a " * 5000, b"b " + b"a " * 700])
    doc, start, n, key, content = cut(h, ends)
    assert n.max() == MOST and n[doc == 0].sum() == 5000 - 12 and n[doc == 1].sum() == 701 - 12
    assert len(set(key[doc == 0].tolist())) == 1 and set(key[doc == 0].tolist()) <= set(key[doc == 1].tolist())


# 4 decontamination


def brute_words(t):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text_of(t)))


def brute_contamination(rows, bench, n=13):
    out = []
    for i, t in rows:
        w, hit, items = brute_words(t), set(), set()
        for item, bt in bench:
            b = brute_words(bt)
            m = min(n, len(b))
            grams = {tuple(b[k : k + m]) for k in range(len(b) - m + 1)} if m else set()
            for k in range(len(w) - m + 1):
                if m and tuple(w[k : k + m]) in grams:
                    hit |= set(range(k, k + m))
                    items.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), len(items), decontam.digest(list(items)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_decontamination(spark, docs, empty, block_bytes):
    bench = [(1, PASSAGE.upper()), (10, "one, two"), (2, None), (3, ""), (4, " ".join(f"w{i}" for i in range(100, 130))), (5, "é"), (None, PASSAGE), (7, "same line")]
    table = spark.createDataFrame(bench, "item_id long, text string")
    got = [tuple(r) for r in decontam.report(docs, table, block_bytes=block_bytes).collect()]
    assert sorted(got, key=str) == sorted(brute_contamination(awkward(), bench), key=str)
    assert decontam.report(empty, table).count() == 0
    assert decontam.report(docs, table.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    clean = decontam.clean(docs, table, block_bytes=block_bytes)
    assert clean.columns == docs.columns
    untouched = {i for (i, *_), x in zip(awkward(), brute_contamination(awkward(), bench), strict=True) if x[2] == 0}
    kept = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert untouched <= set(kept) | {None}
    assert all(kept[i] == t for i, t in awkward() if i in untouched and i not in (None, 112, 113))


def test_decontamination_with_clashing_names_in_blocks(spark):
    names = ["doc_id", "text", "n_words_0", "hits_before", "items", "row", "__own_hits", "hits"]
    df = spark.createDataFrame([(1, "x " + PASSAGE, 1, 2, 3, 4, 5, 6), (2, " ".join(f"w{i}" for i in range(400)) + " " + PASSAGE, 1, 2, 3, 4, 5, 6), (3, None, 1, 2, 3, 4, 5, 6)], "doc_id long, text string, " + ", ".join(f"{c} int" for c in names[2:]))
    bench = spark.createDataFrame([(i, PASSAGE + f" {i}") for i in range(9)], "item_id long, text string")
    for block_bytes in (700, 1 << 20):
        clean = decontam.clean(df, bench, block_bytes=block_bytes)
        assert clean.columns == names
        assert {r["doc_id"]: (r["n_words_0"], r["hits"], r["row"]) for r in clean.collect()} == {2: (1, 6, 4), 3: (1, 6, 4)}
        assert "n_words_0" in decontam.find(df, bench, block_bytes=block_bytes).columns


# 5 BPE


def test_bpe_equals_the_library(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    want = []
    for i, text in awkward():
        ids = t.encode(text_of(text), add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted([tuple(r) for r in bpe.round_trip(docs).collect()], key=str) == sorted(want, key=str)
    assert bpe.round_trip(empty).count() == 0
    back = bpe.decode(bpe.encode(docs)).select("text", "decoded").collect()
    assert all(r["decoded"] == text_of(r["text"]) for r in back)


def test_bpe_on_random_characters():
    from tokenizers import Tokenizer

    with open(bpe.default_vocabulary()) as f:
        told = f.read()
    t, own, r = Tokenizer.from_str(told), bpe.Codec(told), random.Random(9)
    pool = ["'s", "'ll", " ", "  ", "\n", "\t", "a", "Zß", "<|endoftext|>", "½", "²", "é", "\x85", "\xa0", " ", "\x1c", "한", "😀", "1", "12", "_", "!!", "<|"]
    for _ in range(3000):
        x = "".join(r.choice(pool) for _ in range(r.randint(0, 12)))
        assert own.encode(x) == t.encode(x, add_special_tokens=False).ids
    ids = [r.randrange(50257) for _ in range(2000)]
    assert all(own.decode(ids[k : k + 5]) == t.decode(ids[k : k + 5], skip_special_tokens=False) for k in range(1990))


# 6 toxicity


def auc(score, label):
    score, label = np.array(score), np.array(label)
    order = score.argsort()
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n = label.sum()
    return (rank[label == 1].sum() - n * (n - 1) / 2) / (n * (len(label) - n))


def test_toxicity(spark, docs, empty):
    tables = [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")]
    out = toxicity.toxicity(*tables).join(tables[1], "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert auc([r["score"] for r in held], [r["toxic"] for r in held]) > 0.95
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1), (0, 0)], "doc_id long, toxic int")
    for own in (labels, labels.limit(0)):
        got = toxicity.toxicity(docs, own).collect()
        assert len(got) == len(awkward()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert toxicity.toxicity(empty, labels).count() == 0


def test_misspellings_share_vectors():
    texts = ["you are an idiot and a fool"] * 30 + ["the weather is fine and dry today"] * 30
    s = toxicity.Scorer(toxicity.train(texts, [1] * 30 + [0] * 30))
    assert s.score("idiott") > 0.5 > s.score("weather")


def test_training_steps_and_scores_equal_brute_force():
    import math
    import pickle

    texts = ["You are an IDIOT, and a fool!", "fine weather today", "idiot idiot", "", "(the) weather is... fine " + "x_" * 50, "a fool"]
    labels = [1, 0, 1, 0, 0, 1]

    def grams(text):
        out = []
        for token in text.lower().split():
            edged = f"<{token.strip(toxicity.PUNCTUATION) or token}>"
            out.append(crc32(edged.encode()) % toxicity.BUCKETS)
            out += [crc32(edged[i : i + n].encode(), n) % toxicity.BUCKETS for n in (3, 4, 5) for i in range(len(edged) - n + 1)]
        return out

    bags = [grams(t) for t in texts]
    live = sorted({b for own in bags for b in own})
    state = {k: v.astype(float) for k, v in toxicity.start(len(live), 0.5, 7).items()}
    first, second = {k: np.zeros_like(v) for k, v in state.items()}, dict.fromkeys(state, 0.0)
    for step in (1, 2, 3):
        grad = {k: np.zeros_like(v) for k, v in state.items()}
        for own, y in zip(bags, labels, strict=True):
            at = [live.index(b) for b in own]
            mean = state["e"][:, at].mean(1) if at else np.zeros(toxicity.DIM)
            d = (1 / (1 + math.exp(-(state["w"] @ mean * 30 + state["b"][0]))) - y) / len(texts)
            grad["w"] += d * 30 * mean
            grad["b"] += d
            for i in at:
                grad["e"][:, i] += d * 30 * state["w"] / len(at)
        grad["e"] += toxicity.DECAY * state["e"] / len(live)
        for k, g in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * (g * g).mean()
            state[k] -= toxicity.RATE * (first[k] / (1 - 0.9**step)) / (math.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model = toxicity.train(texts, labels, 3)
    table, bias = pickle.loads(model)
    want = state["w"] @ state["e"] * 30
    assert table[live] == pytest.approx(want, rel=1e-3, abs=1e-5) and bias == pytest.approx(state["b"][0], abs=1e-5)
    assert not np.delete(table, live).any()
    scorer = toxicity.Scorer(model)
    for t in [*texts, "unseen idiots " * 400, "weather" * 10_000, None, " \n"]:
        own = grams(text_of(t))
        mean = float(np.mean(table[own].astype(float))) if own else 0.0
        assert scorer.score(t) == pytest.approx(1 / (1 + math.exp(-(mean + bias))), rel=1e-6)


def test_long_tokens_count_whole():
    texts = ["you are an idiot and a fool"] * 30 + ["the weather is fine and dry today"] * 30
    s = toxicity.Scorer(toxicity.train(texts, [1] * 30 + [0] * 30))
    calm = "weather_" * 20
    for bad in (calm + "idiot_" * 20 + calm, calm + "fool-" * 20 + calm):
        assert s.score(bad) > s.score(calm + "today_" * 20 + calm)
    for n in (64, 65, toxicity.STRETCH - 1, toxicity.STRETCH + 1, 2 * toxicity.STRETCH, 50_000):
        word = "".join(chr(0x4E00 + i * 7919 % 20_000) for i in range(n))
        parts = list(toxicity.bags(word))
        assert sorted(b for part in parts for b in part) == sorted(toxicity.bag(word))
        assert len(toxicity.bag(word)) == 1 + sum(n + 2 - k + 1 for k in toxicity.GRAMS)


# 7 fingerprints


def brute_marks(t, k=16, window=16):
    """[(hash, position)] of every window's least hash, rightmost of equal ones."""

    def turn(x, r):
        return (x << r | x >> (64 - r)) & (2**64 - 1)

    def gram(g):
        if len(g) == 4:
            return xxhash.xxh64_intdigest(g.encode(), seed=42)
        half = len(g) // 2
        return turn(gram(g[:half]), winnow.TURN[len(g)]) ^ gram(g[half:])

    def signed(h):
        h &= 2**56 - 1
        return h - 2**56 if h >> 55 else h

    t = text_of(t)
    known = {}
    if not t:
        return []
    h = [signed(known.get(t[i : i + k]) or known.setdefault(t[i : i + k], gram(t[i : i + k]))) for i in range(len(t) - k + 1)] or [signed(xxhash.xxh64_intdigest(t.encode(), seed=42))]
    out = []
    for s in range(max(len(h) - window + 1, 1)):
        at = max(range(s, min(s + window, len(h))), key=lambda i: (-h[i], i))
        if not out or out[-1][1] != at:
            out.append((h[at], at))
    return out


def mark_texts():
    r = random.Random(10)
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    texts = [None, "", " ", "ab", "x" * 15, "x" * 16, "x" * 400, "ab" * 300, "é😀" * 90]
    texts += [some("ab", n) for n in (17, 30, 31, 32, 127, 128, 129, 157, 158, 159, 160, 255, 256, 257, 286, 287, 300, 1000)]
    texts += [some("abcdefgh 北京é😀\n\r\u2028\x85", r.randint(0, 900)) for _ in range(30)]
    return texts


def test_winnowing_equals_brute_force(spark):
    texts = mark_texts()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, marks int, __no int")
    got = winnow.append_marks(df, "text", "marks")
    assert sorted(got.columns) == sorted(df.columns)
    got = {x["doc_id"]: [tuple(m) for m in x["marks"]] for x in got.collect()}
    assert got == {i: brute_marks(t) for i, t in enumerate(texts)}


def test_fingerprints(spark, docs, empty):
    rows = awkward() + [(500 + i, t) for i, t in enumerate(mark_texts())]
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, []).append(text_of(t))
    order = sorted(by_id, key=lambda i: (i is not None, i or 0))
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    sets = {t: {h for h, _ in brute_marks(t)} for _, t in rows}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = []
    for i, t in rows:
        t, following = text_of(t), min(by_id[after[i]])
        changed = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        own, other = ({h for h, _ in brute_marks(x)} if x not in sets else sets[x] for x in (t, changed))
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), round(like(own, other), 9), round(like(own, sets.get(following) or {h for h, _ in brute_marks(following)}), 9)))
    got = winnow.edited(make(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got), key=str) == sorted(want, key=str)
    # one fingerprint for each set of hashes, the edited text's included
    named = {}
    for r in got:
        for t in by_id[r["doc_id"]]:
            if len(by_id[r["doc_id"]]) == 1:
                assert named.setdefault(frozenset(sets[t] if t in sets else sets[None]), r["fingerprint"]) == r["fingerprint"]
                following = min(by_id[after[r["doc_id"]]])
                changed = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
                assert named.setdefault(frozenset(h for h, _ in brute_marks(changed)), r["edited_fingerprint"]) == r["edited_fingerprint"]
    assert len(set(named.values())) == len(named)
    assert winnow.edited(empty).count() == 0
    assert winnow.edited(docs.filter("doc_id = 104")).first()["near_next"] == 1.0


def test_one_character_moves_all_and_keeps_nearly_all_marks(spark):
    r = random.Random(11)
    for letters in ("abcdefghij", "".join(chr(0x4E00 + i) for i in range(2000))):
        whole = "".join(r.choice(letters) for _ in range(2000))
        df = spark.createDataFrame([(0, whole), (1, "x" + whole)], "doc_id long, text string")
        a, b = ([tuple(m) for m in x["marks"]] for x in winnow.append_marks(df, "text", "marks").orderBy("doc_id").collect())
        assert len({(h, p + 1) for h, p in a} & set(b)) >= len(a) - 2 > 100


# 8 chat


def test_chat_round_trip(spark):
    r = random.Random(11)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "[SEP]", "[ROLE]", "[/ROLE]", "\\", "<", "[", "]", " ", "\n", "x", "é", "😀", "[\\INST]", "<\\\\/s>", "/s>", "$1"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "assistant", None, "[SEP]"]), None if r.random() < 0.1 else "".join(r.choice(bits) for _ in range(r.randint(0, 8)))) for c in range(60) for t in range(r.randint(1, 12))]
    rows += [(97, t, "user" if t % 3 else "assistant", f"turn {t}") for t in range(1500)]
    rows += [(None, 1, "user", "a"), (99, None, "assistant", "b"), (99, 0, "user", "c"), (98, 1, "user", "d"), (98, 1, "user", "d"), (98, 1, "assistant", "e")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, formatted string")
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), text_of(role), text_of(text)))
    got = {x["conv_id"]: x for x in chat.report(df).collect()}
    made = {x["conv_id"]: x for x in chat.format_chats(df).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [x[1:] for x in sorted(turns)]
        loss = "".join(t for role, t in turns if role == "assistant")
        g = got[c]
        assert g["n_turns"] == len(turns)
        assert g["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g["formatted_chars"] == len(made[c]["formatted"])
    assert chat.report(df.limit(0)).count() == 0


# 9 lines


def brute_lines(rows, run=2, long=101):
    import re

    place = lambda i, j: ((i is not None, i or 0), j)
    first, cut = {}, []
    for i, t in rows:
        lines = [] if t is None else t.split("\n")
        solid = [k for k, x in enumerate(lines) if not re.fullmatch(r"[ \t\r]*", x)]
        runs = {(j, n) for j in range(len(solid)) for n in (1, run) if (n == run and j + run <= len(solid)) or (n == 1 and len(lines[solid[j]]) >= long)}
        cut.append((lines, solid, runs))
        for j, n in runs:
            g = tuple(lines[k] for k in solid[j : j + n])
            first[g] = min(first.get(g, place(i, j)), place(i, j))
    out = []
    for (i, _), (lines, solid, runs) in zip(rows, cut, strict=True):
        gone = set()
        for j, n in runs:
            if first[tuple(lines[k] for k in solid[j : j + n])] < place(i, j):
                gone |= set(range(solid[j], solid[j + n - 1] + 1))
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out.append((i, len(lines), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("run", [1, 2, 3])
def test_line_dedup(spark, docs, empty, run):
    r = random.Random(12)
    rows = awkward() + [(200 + i, "\n".join(r.choice(["a", "b", "c", "", " ", "long line"]) for _ in range(r.randint(0, 12)))) for i in range(60)]
    long = "a line of its own " * 6
    rows += [(300, f"x\n{long}\ny"), (301, long), (302, f"z\n{long[:-9]}\nw"), (303, f"{long[:-9]}"), (304, f"{long}\n{long}"), (305, "é" * 100), (306, "é" * 100 + "\nv"), (307, "é" * 101), (308, "u\n" + "é" * 101)]
    got = [tuple(x) for x in linededup.report(make(spark, rows), run=run).collect()]
    assert sorted(got, key=str) == sorted(brute_lines(rows, run), key=str)
    assert linededup.report(empty).count() == 0
    assert linededup.dedup_lines(docs).columns == docs.columns


def test_line_fingerprints_are_window_minima_and_carry_the_result(spark, monkeypatch):
    r = random.Random(14)
    rows = [(i, "\n".join(r.choice("abcdefgh") for _ in range(r.randint(0, 30)))) for i in range(30)]
    df = make(spark, rows)
    hashes = {x["c"]: x["h"] for x in spark.createDataFrame([(c,) for c in "abcdefgh"], "c string").withColumn("h", F.xxhash64("c")).collect()}
    for run in (1, 2, 4):
        got = {}
        for x in linededup.fingerprints(df, run=run).collect():
            got.setdefault(x["doc_id"], {})[x["j"]] = sorted(w["s"] for w in x["runs"])
        for i, t in rows:
            h = [hashes[c] for c in t.split("\n")] if t else []
            want = {}
            for s in range(len(h) - run + 1):
                want.setdefault(max(range(s, s + run), key=lambda k: (-h[k], k)), []).append(s)
            assert got.get(i, {}) == want
    # nothing is deleted but through a shared fingerprint: where all lines' hashes count as one, or as none, the result is wrong
    right = sorted(tuple(x) for x in linededup.report(df).collect())
    assert right == sorted(brute_lines(rows))
    real = linededup.fingerprints
    for broken in (F.lit(0).cast("long"), F.xxhash64("doc_id", "j")):
        monkeypatch.setattr(linededup, "fingerprints", lambda *a, broken=broken: real(*a).withColumns({"line_1": broken, "line_2": broken}))
        assert sorted(tuple(x) for x in linededup.report(df).collect()) != right


# 10 language


def brute_forward(word, table, names):
    """The probabilities of a word's beginnings by adding up all segmentations."""
    p = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(j):
            k = names.get(word[i:j])
            p[j] += p[i] * (table[k] if k is not None else langid.UNSEEN if j - i == 1 else 0)
    return p


def test_no_piece_of_letters_is_left_out():
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    assert set(langid.vocabulary()) == {p for p in pieces if p == langid.START or p.removeprefix(langid.START).isalpha()}
    assert max(map(len, langid.vocabulary())) == 16


def test_learning_makes_no_python_object_of_a_row():
    """The driver holds the words of a sample, not a tuple for each language and word."""
    import tracemalloc

    words = [f"w{i:05}" for i in range(5_000)]
    rows = pa.table({"lang": [x for x in ("fr", "de", "en", "it") * 5 for _ in words], "word": words * 20, "n": np.arange(100_000) % 7})
    tracemalloc.start()
    langs, names, weight = langid.weights(rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (langs, names) == (["de", "en", "fr", "it"], words)
    assert weight[3, 0] == sum((5_000 * k + 3) % 7 for k in range(1, 20, 4)) and weight.sum() == (np.arange(100_000) % 7).sum()
    assert most < 60 * 100_000  # three lists and a list of tuples took some 200 a row
    assert [len(x) for x in langid.weights(rows.slice(0, 0))] == [0, 0, 0]


def test_language_model_equals_brute_force():
    import math

    pieces = langid.vocabulary()
    model = langid.learn([("en", "the", 5), ("en", "weather", 2), ("fr", "le", 5), ("fr", "temps", 2), ("fr", "čšž", 1)], pieces)
    m = langid.loaded(model)
    names = {x: i for i, x in enumerate(pieces)}
    r = random.Random(13)
    words = ["the", "weather", "temps", "xyzzy", "č", "ж", "internationalisation", "a" * 24, "a" * 25, "weather" * 5]
    words += ["".join(r.choice("aehrtwč") for _ in range(n)) for n in (langid.CACHED, langid.CACHED + 1, 90)]
    for w, row in zip(words, m.word_logs(words), strict=True):
        for k in range(2):
            assert row[k] == pytest.approx(math.log(brute_forward(langid.START + w, m.table[:, k], names)[-1]), rel=1e-9)
    assert m.table[: len(pieces)].sum(0) == pytest.approx([1, 1])
    lang, score = m.predict(["The weather", "le temps", "123 !", None, ""])
    assert lang == ["en", "fr", "und", "und", "und"] and score[:2].min() > 0.5 and score[2:].max() == 0
    # whole texts: the sum over their words, whatever their length
    texts = ["the weather " + "the" * 40 + " le", "temps " * 50, "x" * 3000]
    lang, score = m.predict(texts)
    for t, own, x in zip(texts, lang, score, strict=True):
        total = m.word_logs(t.split()).sum(0)
        assert own == m.langs[int(total.argmax())] and x == pytest.approx(1 / np.exp(total - total.max()).sum())
    assert np.isfinite(m.word_logs(["the" * 20_000, "ж" * 70_000])).all()


def test_one_round_of_learning_equals_brute_force(monkeypatch):
    pieces = ["a", "ab", "b", "abc", "▁a", "▁", "c", "bc"]
    words = {"abc": 3, "ab": 2, "abcabc": 1, "xa": 4, "abcab" * 30: 2}
    monkeypatch.setattr(langid, "ROUNDS", 1)
    names, n = {x: i for i, x in enumerate(pieces)}, len(pieces)
    table, seen = [1 / n] * n, [0.0] * n
    for w, count in words.items():
        w = langid.START + w
        f, g = brute_forward(w, table, names), brute_forward(w[::-1], table, {x[::-1]: i for x, i in names.items()})
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                if w[i:j] in names:
                    seen[names[w[i:j]]] += count * f[i] * table[names[w[i:j]]] * g[len(w) - j] / f[-1]
    want = [x + langid.SMOOTHING + x / max(sum(seen), 1) * 100 for x in seen]
    got = langid.loaded(langid.learn([("xx", w, c) for w, c in words.items()], pieces)).table[:n, 0]
    assert got == pytest.approx([x / sum(want) for x in want], rel=1e-9)


def test_language_id(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(table).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert {r["lang_pred"] for r in langid.identify(docs).collect()} == {"und"}  # nothing to learn from
    assert langid.identify(empty).count() == 0
    some = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx"))
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(some).collect()}
    assert {(100, "und"), (101, "und"), (103, "und"), (104, "xx")} <= got
    assert langid.reject_unknown(some).columns == some.columns


def test_new_columns_replace_those_of_their_name(docs):
    from pyspark.sql.types import IntegerType

    out = append_columns(docs, lambda: lambda texts: [list(range(len(texts)))], [("score", IntegerType())])
    assert sorted(out.columns) == sorted(docs.columns) and out.count() == len(awkward())


def test_a_cluster_needs_a_shared_folder():
    from unittest.mock import MagicMock

    from titleweave.llm.common import shared_dir

    spark = MagicMock()
    spark.conf.get.return_value = spark.sparkContext.getConf().get.return_value = None
    spark.sparkContext._jsc.sc().getCheckpointDir().isDefined.return_value = False
    spark.sparkContext.master = "spark://host:7077"
    with pytest.raises(ValueError):
        shared_dir(spark)
    spark.conf.get.return_value = "hdfs:///shared"
    assert shared_dir(spark) == "hdfs:///shared"
