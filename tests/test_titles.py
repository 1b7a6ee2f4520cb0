import math
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from titleweave.functions import normalize, similarity
from titleweave.operators import candidates, evaluate, features, frequency, matching, misspell, training
from titleweave.plans import cascade
from titleweave.sources import titles


def plain_transform(x, n=255):
    t = unicodedata.normalize("NFD", x).encode("ascii", "ignore").decode().lower().replace("-", " ")
    t = re.sub(" +", " ", re.sub(r"[^a-zA-Z0-9\s]", "", t)).strip()
    return t.rjust(3, "0") if len(t) < 3 else t[:n].strip()


def test_normalisation_equals_a_plain_version(spark):
    r = random.Random(1)
    pool = "aB9-_. \t\n,éÉßÆøñçüŠ–北京́\x1c\x85½" + "".join(chr(i) for i in range(0xC0, 0x250))
    texts = ["", "ab", "É", "A–B", "Société Générale-X", "Customer#000000042", "a\tb", "x" * 300, "a" * 254 + " b"]
    texts += ["".join(r.choice(pool) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [x[0] for x in df.select(normalize.transform_title(F.col("t"))).collect()]
    assert got == [plain_transform(t) for t in texts]


def test_word_frequencies_and_codes(spark):
    lists = [["elm", "oak", "elm"], ["oak"], ["ash", "oak", "ash", "fir"], []]
    df = spark.createDataFrame([(x,) for x in lists], "words array<string>")
    assert {r["word"]: r["df"] for r in frequency.word_frequency(df).collect()} == {w: sum(w in x for x in lists) for x in lists for w in x}
    assert spark.range(1).select(frequency.idf(F.lit(3), 8)).first()[0] == pytest.approx(math.log(8 / 3))
    code = spark.range(1).select(normalize.encode_title(F.lit("az 09-"))).first()[0]
    assert code == [2, 27, 1, 28, 37, 0]


def test_null_and_short_titles(spark):
    df = titles.with_derived(spark.createDataFrame([(1, None), (2, ""), (3, "北京")], "id long, title string"))
    assert [(r["transformed_title"], r["n_grams"]) for r in df.orderBy("id").collect()] == [(None, None), ("000", ["000"]), ("000", ["000"])]


def table_lcs(a, b):
    last = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(last[j] + 1 if x == y else max(now[-1], last[j + 1]))
        last = now
    return last[-1]


def test_lcs_and_ratios(spark):
    r = random.Random(2)
    pairs = [("".join(r.choice("abc é😀") for _ in range(r.randint(0, 200))), "".join(r.choice("abcdé") for _ in range(r.choice([0, 1, 63, 64, 65, 128, 129, 200, r.randint(0, 255)])))) for _ in range(300)]
    assert similarity.lcs_lengths(*map(list, zip(*pairs, strict=True))).tolist() == [table_lcs(a, b) for a, b in pairs]
    assert similarity.lcs_lengths([], []).tolist() == []
    nulls = spark.createDataFrame([(None, "a"), ("a", None), ("ab", "b")], "a string, b string")
    assert [x[0] for x in nulls.select(similarity.lcs(F.col("a"), F.col("b"))).collect()] == [None, None, 1]
    table = [("coolblue bv", "colblue b v", 91, 90, 82), ("ab", "ac", 50, 50, 50), ("kitten", "sitting", 62, 61, 62), ("abcdefghijklmnopqrst", "abcdefghijklmnopqrs", 97, 97, 97), ("bv coolblue", "coolblue bv", 73, 72, 100)]
    df = spark.createDataFrame([x[:2] for x in table], "a string, b string")
    got = df.select(similarity.indel_ratio(F.col("a"), F.col("b")), similarity.indel_ratio_truncated(F.col("a"), F.col("b")), similarity.token_sort_ratio(F.col("a"), F.col("b"))).collect()
    assert [tuple(x) for x in got] == [x[2:] for x in table]


def test_worked_pair_features(spark):
    df = spark.createDataFrame([("colblue b v", "coolblue bv", [1, 50])], "title string, match string, counts array<int>")
    r = features.all_features(df, 1000).first()
    assert [r[c] for c in features.BASIC] == [11, 11, 3, 2, 90, 90]
    assert [r["best_1"], r["best_2"], r["best_3"]] == [87, 100, None]
    assert [r["length_1"], r["length_2"]] == [8, 2]
    assert [round(r[c], 6) for c in ("idf_1", "idf_2", "rank_1", "rank_2")] == [6.907755, 2.995732, 1.0, 2.956012]
    assert len(features.names()) == 66
    assert similarity.word_stretches(["colblue b v"], ["coolblue bv"], 15) == ([[87, 100]], ["colblueb bv"])


def test_stretches_of_words_equal_their_definition(spark):
    r = random.Random(4)
    made = lambda letters, sizes, n: " ".join("".join(r.choice(letters) for _ in range(r.choice(sizes))) for _ in range(n))
    pairs = [(made("abcde", [1, 2, 5, 8], r.randint(1, 6)), made("abcdez", [1, 3, 7, 9, 70], r.randint(1, 6))) for _ in range(150)] + [("   ", "ab"), ("ab", ""), ("zzz", "qq a")]

    def whole(title, truth, limit):
        solid, ratios, parts = title.replace(" ", ""), [], []
        for word in truth.split(" ")[:limit]:
            every = [solid[i : i + len(word)] for i in range(len(solid) if word else 0)]
            ratio = [int(2 * table_lcs(x, word) / (len(x) + len(word)) * 100) for x in every]
            top = max(ratio, default=0)
            ratios.append(top)
            parts.append(every[ratio.index(top)] if top else " ")
        return ratios, " ".join(parts)

    ratios, rebuilt = similarity.word_stretches([a for a, _ in pairs], [b for _, b in pairs], 4)
    assert list(zip(ratios, rebuilt, strict=True)) == [whole(a, b, 4) for a, b in pairs]
    df = spark.createDataFrame([("ab", None), (None, "ab"), ("ab c", "abc")], "a string, b string")
    assert [x[0] and tuple(x[0]) for x in df.select(similarity.word_matches(F.col("a"), F.col("b"), 15)).collect()] == [(None, None), (None, None), ([100], "abc")]


def test_worked_likeness(spark):
    truth = titles.with_derived(spark.createDataFrame([(0, "coolblue bv"), (1, "coolblue nv"), (2, "redstone bv"), (3, "blue pool")], "title_id long, title string"))
    query = titles.with_derived(spark.createDataFrame([(0, "colblue bv")], "test_index long, title string"))
    got = candidates.closest_matches(query, candidates.build_index(truth), 10)
    assert {r["title_id"]: r["score"] for r in got.collect()} == {0: 0.605661, 1: 0.256325, 2: 0.094139, 3: 0.091149}


@pytest.mark.parametrize("look", [1, 30, 4096])
@pytest.mark.parametrize("cell", [7, 50_000])
def test_top_k_equals_brute_force_with_ties_and_copies(spark, monkeypatch, look, cell):
    monkeypatch.setattr(candidates, "FIRST_LOOK", look)
    monkeypatch.setattr(candidates, "CELL_TITLES", cell)
    r = random.Random(3)
    names = ["".join(r.choice("abcde ") for _ in range(r.randint(3, 9))) for _ in range(40)]
    truth = titles.with_derived(spark.createDataFrame([(i, r.choice(names)) for i in range(120)], "title_id long, title string"))
    query = titles.with_derived(spark.createDataFrame([(i, r.choice(names)) for i in range(30)], "test_index long, title string"))
    index = candidates.build_index(truth)
    grams = {x["title_id"]: set(x["n_grams"]) for x in truth.collect()}
    weight = lambda g: round(math.log(len(grams) / sum(g in x for x in grams.values())) * 1e6)
    w = {g: weight(g) for x in grams.values() for g in x}
    scores = {}
    for x in query.collect():
        for t, own in grams.items():
            shared = sum(w[g] for g in own & set(x["n_grams"]))
            total = sum(w.get(g, max(w.values())) for g in x["n_grams"]) + sum(w[g] for g in own)
            if shared:
                scores.setdefault(x["test_index"], []).append((-math.floor(1e6 * shared / (total - shared) + 0.5), -t))
    assert sorted((x["test_index"], round(-1e6 * x["score"]), -x["title_id"]) for x in candidates.jaccard_scores(query, index).collect()) == sorted((q, *y) for q, own in scores.items() for y in own)
    for k in (1, 7):
        want = sorted((q, -t, n) for q, own in scores.items() for n, (_, t) in enumerate(sorted(own)[:k], 1))
        assert sorted((x["test_index"], x["title_id"], x["rn"]) for x in candidates.closest_matches(query, index, k).collect()) == want


def test_search_verifies_a_part_of_the_titles(monkeypatch):
    import numpy as np

    monkeypatch.setattr(candidates, "FIRST_LOOK", 100)
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(400)]
    names = sorted({" ".join(r.choice(words) for _ in range(r.randint(2, 6))) for _ in range(3000)})
    gram, df = np.unique(candidates.title_grams(names, 3)[1], return_counts=True)
    cell = candidates.Cell(names, np.arange(len(names)), gram, np.round(np.log(len(names) / df) * 1e6).astype(np.int64), 3)
    asked = [n.replace("a", "", 1) for n in names[::100]]
    got = [cell.search(q, 10) for q in asked]
    pruned, cell.scored = cell.scored, 0
    for q, (at, score) in zip(asked, got, strict=True):
        every, whole = cell.search(q, None)
        best = np.lexsort((-every, -whole))[:10]
        assert (at.tolist(), score.tolist()) == (every[best].tolist(), whole[best].tolist())
    assert pruned < 0.5 * cell.scored


def test_unique_argmax_drops_ties(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (2, 3), (2, 1), (3, None)], "k int, v int")
    assert [r["k"] for r in matching.unique_argmax(df, "k", "v").orderBy("k").collect()] == [2, 3]


def test_keyboard():
    near = misspell.neighbour_strings()
    assert sum(map(len, near.values())) == 80
    assert near["b"] == "gmnv" and near["p"] == "o" and near["n"] == "bhm"


def test_single_edits_and_generator_roll_the_same_dice(spark):
    truth = spark.createDataFrame([(i, t) for i, t in enumerate(["the quick brown fox", "abc", "000", "a b c d", "word", "12 34 5678 90"])], "title_id long, t string")
    for name, change in misspell.EDITS.items():
        got = [r[0] for r in truth.orderBy("title_id").select(change(F.col("t"), misspell.Dice(F.col("title_id"), "7"))).collect()]
        for text, made in zip([r["t"] for r in truth.orderBy("title_id").collect()], got, strict=True):
            assert abs(len(made) - len(text)) <= 1
            if name == "swap_word":
                assert sorted(made.split(" ")) == sorted(text.split(" "))


def test_cascade_covers_every_row_once(spark):
    truth = titles.with_derived(spark.createDataFrame([(1, "Alpha Beta Gamma Limited"), (2, "Alpha Beta Gamma Limited"), (3, "Some Other Company Name"), (4, None)], "title_id long, title string"))
    test = titles.with_derived(spark.createDataFrame([(10, "alpha beta gamma limited"), (70, "Some Other Compny Name"), (30, "Nothing Of The Kind"), (5, None)], "test_index long, title string"))
    got = {r["test_index"]: r["title_id"] for r in cascade.generate_predictions(test, truth).collect()}
    assert got == {10: 2, 70: 3, 30: -1, 5: -1}
    assert cascade.search_title(spark, "Some Other Company Name", truth).first().asDict() == {"title_id": 3, "match": "some other company name", "prediction": 1.0}
    twice = cascade.generate_predictions(test.union(test), truth).collect()
    assert sorted((r["test_index"], r["title_id"]) for r in twice) == sorted(2 * list(got.items()))
    with pytest.raises(ValueError):
        cascade.search_title(spark, "  ", truth)
    assert cascade.generate_predictions(test.limit(0), truth).count() == 0
    assert {r["title_id"] for r in cascade.generate_predictions(test, truth.limit(0)).collect()} == {-1}


def test_model(spark, small, tmp_path):
    from dataclasses import replace

    from titleweave.config import DEFAULT
    from titleweave.plans import registry

    config = replace(DEFAULT, rounds=3, depth=3)
    truth = titles.truth_titles(spark, small)
    train = registry.train_titles(spark, small)
    model = cascade.train_matcher(train, truth, config)
    training.save_model(model, f"file://{tmp_path}/model")
    again = training.load_model(f"file://{tmp_path}/model")
    test = registry.cascade_test(spark, small)
    got = cascade.generate_predictions(test, truth, again, config).collect()
    assert sorted(r["test_index"] for r in got) == sorted(r["test_index"] for r in test.select("test_index").collect())
    assert abs(sum(r["share"] for r in evaluate.feature_importance(model, spark, config).collect()) - 1) < 1e-9
    assert cascade.search_title(spark, "an unheard of title erin", truth, again, config).count() <= 1


def test_accuracy_needs_a_prediction_for_every_row(spark):
    a = spark.createDataFrame([(1, 5), (2, -1)], "test_index long, title_id long")
    assert evaluate.accuracy_report(a, a).first().asDict() == {"correctly_matched": 1, "incorrectly_matched": 0, "correctly_not_found": 1, "incorrectly_not_found": 0, "custom_error": 0.0}
    with pytest.raises(Exception, match="no prediction"):
        evaluate.accuracy_report(a, a.filter("test_index = 1")).collect()


def test_delimited_text_comes_back_as_it_was(spark, tmp_path):
    odd = ['a "quoted" name', '"', '""', "\\", "a\\", 'b\\"c', '\\"', "a|b", "|", " led", "trailed ", " ", "", None, "two\nlines", "tab\t", "é北\r", 'token = "x"']
    df = spark.createDataFrame(list(enumerate(odd)), "test_index long, name string")
    titles.write_delimited(df, f"file://{tmp_path}/odd")
    got = {r["test_index"]: r["title"] for r in titles.read_delimited(spark, f"file://{tmp_path}/odd", "test").collect()}
    assert got == dict(enumerate(odd))


def test_evaluation_of_a_model(spark):
    r = random.Random(8)
    rows = [(r.random() < 0.3, r.randint(0, 40) / 40, r.randint(0, 1)) for _ in range(400)]
    got = {x["is_eval"]: x for x in evaluate.evaluation(spark.createDataFrame(rows, "is_eval boolean, p double, y int")).collect()}
    for part in (True, False):
        own = [(p, y) for e, p, y in rows if e == part]
        up, down = [p for p, y in own if y], [p for p, y in own if not y]
        x = got[part]
        assert x["area"] == pytest.approx(sum((a > b) + (a == b) / 2 for a in up for b in down) / len(up) / len(down))
        assert (x["true_positives"], x["false_positives"]) == (sum(p > 0.9 for p in up), sum(p > 0.9 for p in down))
        assert x["custom_error"] == x["false_negatives"] + 5 * x["false_positives"] and x["true_negatives"] == sum(p <= 0.9 for p in down)
    assert evaluate.area_under_curve(spark.createDataFrame([(0.5, 1)], "p double, y int")).first()["area"] is None


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text('company_id|name|more\n1|"A ""quoted"" name"|x\n2|Plain|y\n')
    got = titles.read_delimited(spark, f"file://{tmp_path}/t.csv", "truth")
    assert [(r["title_id"], r["title"], r["number_of_words"]) for r in got.orderBy("title_id").collect()] == [(1, 'A "quoted" name', 3), (2, "Plain", 1)]
    with pytest.raises(ValueError):
        titles.truth(got, mapping={"title": ("title", "string")})
    titles.write_delimited(got.select("title_id", F.col("title_id").alias("test_index")), f"file://{tmp_path}/out", single_file=True)
    assert next((tmp_path / "out").glob("part*")).read_text() == "title_id|test_index\n1|1\n2|2\n"


def test_stream(spark, tmp_path):
    from titleweave.streaming.near_match import match_stream

    truth = titles.with_derived(spark.createDataFrame([(1, "Alpha Beta Gamma Limited")], "title_id long, title string"))
    spark.createDataFrame([(1, "alpha beta gamma limited"), (2, "zzz")], "test_index long, title string").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("test_index long, title string").parquet(f"file://{tmp_path}/in")
    found = []
    match_stream(stream, truth, lambda df, n: found.extend(df.collect())).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r["test_index"], r["title_id"]) for r in found) == [(1, 1), (2, -1)]


def test_command_line(spark, tmp_path, capsys):
    from titleweave import cli, timing

    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 9)))
    names = [" ".join(word() for _ in range(3)) for _ in range(40)]
    paths = {k: f"file://{tmp_path}/{k}" for k in ("truth.csv", "train.csv", "test.csv", "actuals.csv", "model", "out")}
    table = lambda head, rows: head + "\n" + "".join("|".join(map(str, x)) + "\n" for x in rows)
    (tmp_path / "truth.csv").write_text(table("company_id|name", enumerate(names)))
    (tmp_path / "train.csv").write_text(table("train_index|name|company_id", [(i, n.replace("a", "", 1), i) for i, n in enumerate(names[:20])] + [(90, "nothing alike", -1)]))
    (tmp_path / "test.csv").write_text(table("test_index|name", [(1, names[3].upper()), (2, names[5][:-1]), (3, "zzz zzz")]))
    (tmp_path / "actuals.csv").write_text(table("test_index|company_id", [(1, 3), (2, 5), (3, -1)]))

    def called(*argv):
        return cli.run(spark, cli.parser().parse_args(argv))

    assert called("generate-predictions", "--test", paths["test.csv"], "--truth", paths["truth.csv"], "--output", paths["out"]) == [paths["out"]]
    assert called("get-predictions-accuracy", "--actuals", paths["actuals.csv"], "--predictions", paths["out"]) == ["correctly_matched=2, incorrectly_matched=0, correctly_not_found=1, incorrectly_not_found=0, custom_error=0.0"]
    assert called("closest-search-single-title", "-t", names[7], "--truth", paths["truth.csv"]) == [f"title_id=7, match={names[7]}, prediction=1.0"]
    lines = called("train-model", "--train", paths["train.csv"], "--truth", paths["truth.csv"], "--model", paths["model"])
    assert len(lines) == 2 and all("area=" in x for x in lines)
    assert called("closest-search-single-title", "-t", names[7], "--truth", paths["truth.csv"], "--model", paths["model"]) == [f"title_id=7, match={names[7]}, prediction=1.0"]
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["--version"])
    assert "titleweave" in capsys.readouterr().out
    assert (timing.spelt(0.26), timing.spelt(61), timing.spelt(7384.5)) == ("0.3 s", "1 min 1.0 s", "2 h 3 min 4.5 s")


def _near_titles():
    import random

    dice = random.Random(5)
    words = ["".join(dice.choice("abcde") for _ in range(dice.randint(1, 7))) for _ in range(60)]
    names = [" ".join(dice.choice(words) for _ in range(dice.randint(1, 30)))[:120].strip() for _ in range(120)] + ["and " * 30 + "and", "a b c d e f g h", "abc", "abcd"]
    asked = []
    for t in names:
        x = list(t)
        for _ in range(dice.randint(0, max(1, len(t) // 12))):
            x[dice.randrange(len(x))] = dice.choice(["", "a", "b", "zz"])
        parts = " ".join("".join(x).split()).split(" ")
        if dice.random() < 0.5:
            dice.shuffle(parts)
        asked.append(" ".join(parts))
    return [n.rjust(3, "0") for n in names], [a.rjust(3, "0") for a in asked]


@pytest.mark.parametrize("threshold", [94.0, 80.0, 30.0])
def test_near_titles_are_all_found_without_comparing_all(threshold):
    from titleweave.functions.similarity import near_ratios

    names, asked = _near_titles()
    names = sorted(set(names))
    near = candidates.Near(names)
    by_word = candidates.Near([" ".join(sorted(n.split(" "))) for n in names])
    share = (np.floor(threshold) + 0.5) / 100
    got = [near.alike(asked, share), by_word.alike([" ".join(sorted(a.split(" "))) for a in asked], share)]
    found = {(q, t) for x in got for q, t in zip(x[0].tolist(), x[1].tolist(), strict=True)}
    ratio = np.array([near_ratios([a] * len(names), names, threshold) for a in asked])
    true = {(int(q), int(t)) for q, t in np.argwhere(ratio > threshold)}
    assert true and true <= found
    if threshold > 90:
        assert len(found) < len(names) * len(asked) / 10
    pairs = np.array(sorted(true))
    assert near.with_letters(asked, pairs[:, 0], pairs[:, 1], share).all()


def test_near_pairs_are_the_closest_pairs_from_the_worst_near_one_on(spark):
    names, asked = _near_titles()
    truth = titles.with_derived(spark.createDataFrame([(i, n) for i, n in enumerate(names + names[:9])], "title_id long, title string"))
    test = titles.with_derived(spark.createDataFrame(list(enumerate(asked)), "test_index long, title string"))
    index = candidates.build_index(truth)
    for k in (3, 100):
        whole = candidates.closest_pairs(test, index, k)
        got = {tuple(r) for r in candidates.near_pairs(test, index, k).collect()}
        near = {(r.test_index, r.title_id) for r in matching.near_ratio(whole).collect()}
        assert got <= {tuple(r) for r in whole.collect()} and near and near <= {x[:2] for x in got}
        a, b = (sorted(map(tuple, matching.near_exact_matches(p).collect())) for p in (whole, spark.createDataFrame(list(got), whole.schema)))
        assert a == b


def test_pairs_of_shared_weight_leave_a_cell_unjoined(spark):
    names, asked = _near_titles()
    truth = titles.with_derived(spark.createDataFrame([(i, n) for i, n in enumerate(names * 3)], "title_id long, title string"))
    test = titles.with_derived(spark.createDataFrame(list(enumerate(asked * 2)), "test_index long, title string"))
    made = candidates.jaccard_scores(test, candidates.build_index(truth))
    assert made.count() == made.distinct().count() > 10_000
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("MapInArrow")[0]  # pairs aren't joined or shuffled any more


def test_positional_search_takes_the_k_best_and_their_ties_from_each_cell():
    names = [f"title number {i % 40:02d} of many" for i in range(400)]
    names = [f"{n} {i // 40}" for i, n in enumerate(names)]
    owner, code = candidates.title_grams(names, 3)
    gram, df = np.unique(code, return_counts=True)
    cell = candidates.Cell(names, np.arange(len(names)), gram, np.round(np.log(len(names) / df) * 1e6).astype(np.int64), 3)
    for q in ("title number 07 of many", "title number 1 of man", "number 39"):
        every, whole = cell.search(q, None)
        kth = -np.sort(-whole)[9]
        got, score = cell.search(q, 10, slack=2)
        assert sorted(got.tolist()) == sorted(every[whole >= kth - 2].tolist()) and len(got) >= 10
        floor = cell.search(q, 10, int(kth) + 1)
        assert sorted(floor[1].tolist()) == sorted(whole[whole > kth].tolist())


def test_model_evaluation_works_out_the_features_once(spark, small, monkeypatch):
    from titleweave.plans import registry
    from titleweave.plans.frozen import frozen_model

    made, table = [], training.feature_table
    for place in (training, cascade):
        monkeypatch.setattr(place, "feature_table", lambda *a: made.append(1) or table(*a))
    monkeypatch.setattr(training, "fit_model", lambda table: frozen_model)
    assert registry.queries()["model_evaluation"](spark, small).count() == 2 and len(made) == 1


def test_wide_cell_finds_what_a_cell_finds(monkeypatch):
    monkeypatch.setattr(candidates, "BLOCK", 700)
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 9))) for _ in range(300)]
    names = sorted({" ".join(r.choice(words) for _ in range(r.randint(2, 40)))[:250].strip() for _ in range(2000)} | {"the end", "000", "of the end of the end"})
    gram, df = np.unique(candidates.title_grams(names, 3)[1], return_counts=True)
    made = names, np.random.default_rng(1).permutation(len(names)), gram, np.round(np.log(len(names) / df) * 1e6).astype(np.int64), 3
    cell, wide = candidates.Cell(*made), candidates.WideCell(*made)
    assert len(wide.blocks) == 3 and 0 < wide.wide.shape[1] < len(gram)
    asked = [n.replace("a", "", 1) for n in names[::25]] + ["zzz", "", "ab", "the end", "z" * 255]
    for k, slack in ((10, 0), (100, 0), (10, 2), (5000, 0)):
        for q, (rows, score) in zip(asked, wide.search(asked, k, slack), strict=True):
            at, whole = cell.search(q, k, slack=slack)
            assert (rows.tolist(), score.tolist()) == (at.tolist(), whole.tolist())


@pytest.mark.parametrize("part", [40, 200_000])
def test_closest_rows_leave_a_cell_ranked(spark, monkeypatch, part):
    monkeypatch.setattr(candidates, "WIDE_TITLES", part)
    names, asked = _near_titles()
    truth = titles.with_derived(spark.createDataFrame([(i, n) for i, n in enumerate(names + names[:30] * 2)], "title_id long, title string"))
    test = titles.with_derived(spark.createDataFrame([(i, n) for i, n in enumerate(asked + asked[:9])] + [(900, None)], "test_index long, title string"))
    index = candidates.build_index(truth)
    scores: dict = {}
    for x in candidates.jaccard_scores(test, index).collect():
        scores.setdefault(x.test_index, []).append((-x.score, -x.title_id))
    title, match = ({r[0]: r.transformed_title for r in x.collect()} for x in (test, truth))
    for k in (10, 25):
        want = sorted((q, -t, title[q], match[-t], -s, n) for q, own in scores.items() for n, (s, t) in enumerate(sorted(own)[:k], 1))
        found = candidates.closest_pairs(test, index, k)
        assert sorted(map(tuple, found.collect())) == want
        assert sorted(map(tuple, candidates.closest_matches(test, index, k).collect())) == [(q, t, s, n) for q, t, _, _, s, n in want]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("Window" in plan) == (part == 40) and "Join" not in plan.split("MapInArrow")[0]


def test_latest_rows_are_read_once(spark):
    rows = [(1, 5, "a"), (2, 5, "b"), (3, 6, "c"), (4, -1, "d"), (5, -1, "e"), (5, -1, "f"), (6, None, "g")]
    got = training.latest_per_title(spark.createDataFrame(rows, "train_index long, title_id long, transformed_title string"))
    assert sorted(map(tuple, got.collect())) == sorted(rows[1:6])
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()  # titles that are dear to make are made once


def test_building_a_cell_takes_little_more_room_than_the_cell():
    import tracemalloc

    r = random.Random(9)
    names = ["".join(r.choice("abcdefgh ") for _ in range(200)) for _ in range(6000)]
    gram, df = np.unique(candidates.title_grams(names, 3)[1], return_counts=True)
    tracemalloc.start()
    cell = candidates.Cell(names, np.arange(len(names)), gram, np.round(np.log(len(names) / df) * 1e6).astype(np.int64), 3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 * len(cell.posted)  # bytes; 57 when all n-grams of a cell were told at once


def _languages(r, n):
    """Titles of three languages that share few n-grams, and words of two of them in some."""
    words = [["".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(60)] for letters in ("abcdefgh", "ijklmnop", "qrstuvwa")]
    of = lambda i: words[i % 3] + (words[(i + 1) % 3] if i % 17 == 0 else [])
    return sorted({" ".join(r.choice(of(i)) for _ in range(r.randint(2, 40)))[:250].strip() for i in range(n)})


@pytest.mark.parametrize("block", [250, 5000])
def test_titles_and_queries_of_a_kind_meet_and_all_are_found(monkeypatch, block):
    monkeypatch.setattr(candidates, "BLOCK", block)
    monkeypatch.setattr(candidates, "LEAST_KINDS", 500)
    names = _languages(random.Random(3), 2000)
    gram, df = np.unique(candidates.title_grams(names, 3)[1], return_counts=True)
    made = names, np.random.default_rng(1).permutation(len(names)), gram, np.round(np.log(len(names) / df) * 1e6).astype(np.int64), 3
    cell, wide = candidates.Cell(*made), candidates.WideCell(*made)
    asked = [n.replace("a", "", 1) for n in names[::9]] + ["zzz", "", "ab", names[0][:9], "z" * 255]
    asked = [asked[i] for i in wide.sorted(asked)]
    told = []
    monkeypatch.setattr(np, "matmul", lambda a, b, out=None, f=np.matmul: told.append((a.shape[1] - 1, a.shape[0] * b.shape[1])) or f(a, b, out=out))
    found = [x for i in range(0, len(asked), 64) for x in wide.search(asked[i : i + 64], 10)]
    monkeypatch.undo()
    for q, (rows, score) in zip(asked, found, strict=True):
        at, whole = cell.search(q, 10)
        assert (rows.tolist(), score.tolist()) == (at.tolist(), whole.tolist())
    # a matrix holds the n-grams that both have, not all that are common somewhere
    assert sum(d * pairs for d, pairs in told) < 0.6 * len(asked) * len(names) * (df >= 0.08 * len(names)).sum()


def test_evaluation_scores_each_pair_once(spark):
    truth = titles.with_derived(spark.createDataFrame([(1, "the first title"), (2, "another one")], "title_id long, title string"))
    pairs = spark.createDataFrame([("the frst title", "the first title", 1, 1, True), ("anothr", "the first title", 1, 0, True), ("another", "another one", 2, 1, False)], "title string, truth_title string, title_id long, target int, is_eval boolean")
    told = cascade.evaluate_model(lambda f: F.col("ratio") / 100, pairs, truth, 2)
    assert told._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.is_eval: tuple(r)[1:] for r in told.collect()} == {True: (1, 1, 0, 0, 0.0, 1.0), False: (0, 0, 0, 1, 1.0, None)}
