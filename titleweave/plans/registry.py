"""Every query by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleweave.config import DEFAULT
from titleweave.functions.normalize import encode_title, transform_title
from titleweave.functions.similarity import indel_ratio, indel_ratio_truncated, length_bound, token_sort_ratio
from titleweave.operators import candidates, evaluate, features, frequency, matching, misspell, training
from titleweave.plans import cascade, oracles
from titleweave.plans.frozen import frozen_model
from titleweave.sources import titles

#: Added to the ids of made-up test rows, so that they meet no document's.
MADE = 1_000_000_000


def _truth(spark, d):
    return titles.truth_titles(spark, d)


def _test(spark, d):
    return titles.test_titles(spark, d)


def _closest(spark, d, k=DEFAULT.top_n_predicting):
    return candidates.closest_matches(_test(spark, d), candidates.build_index(_truth(spark, d)), k)


def _pairs(spark, d):
    """The closest reference titles of each test title, as many as training draws from, with both titles."""
    found = candidates.closest_pairs(_test(spark, d), candidates.build_index(_truth(spark, d)), DEFAULT.top_n_training)
    return found.select("test_index", "title_id", "title", "match")


def _kept(df, key):
    """Normalised titles, worked out once for all that a query does with them."""
    return titles.with_words(df.select(key, "transformed_title").persist())


def cascade_test(spark, d, truth=None):
    """(test_index, transformed_title): the test titles, and a misspelling of every reference title that is long enough."""
    made = training.generated_pairs(truth or _truth(spark, d)).select((F.col("title_id") + MADE).alias("test_index"), F.col("title").alias("transformed_title"))
    return _test(spark, d).select("test_index", "transformed_title").unionByName(made)


def train_titles(spark, d, truth=None):
    """(train_index, title_id, transformed_title): misspellings of all long enough reference titles with their ids, and test titles
    that no reference title equals with -1.
    """
    truth = truth or _truth(spark, d)
    made = training.generated_pairs(truth).select(F.col("title_id").alias("train_index"), "title_id", F.col("title").alias("transformed_title"))
    own = matching.with_exact(_test(spark, d).select("test_index", "transformed_title"), truth).filter("title_id is null")
    return made.unionByName(own.select((F.col("test_index") + MADE).alias("train_index"), F.lit(-1).cast("long").alias("title_id"), "transformed_title"))


def _scored(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", ((F.col("o_orderkey") % 97) / F.lit(97.0)).alias("p"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))


def _training_pairs(spark, d):
    truth = _kept(_truth(spark, d), "title_id")
    return training.training_pairs(train_titles(spark, d, truth), truth, candidates.build_index(truth))


def _model(spark, d):
    truth = _kept(_truth(spark, d), "title_id")
    return cascade.train_matcher(train_titles(spark, d, truth), truth)


def _frozen_evaluation(spark, d):
    truth = _kept(_truth(spark, d), "title_id")
    index = candidates.build_index(truth)
    pairs = cascade.labelled_pairs(train_titles(spark, d, truth), truth, index=index)
    return cascade.evaluate_model(frozen_model, pairs, truth, index.n)


def _trained_evaluation(spark, d):
    truth = _kept(_truth(spark, d), "title_id")
    index = candidates.build_index(truth)
    pairs = cascade.labelled_pairs(train_titles(spark, d, truth), truth, index=index)
    table = training.feature_table(pairs, truth, index.n).persist()  # for fitting and for what the model makes of it
    return cascade.evaluate_table(training.fit_model(table), table)


def _feature_table(spark, d):
    truth = _truth(spark, d)
    made = training.feature_table(_pairs(spark, d), truth, frequency.number_of_titles(truth))
    return made.select("test_index", "title_id", *[F.round(c, 6).alias(c) for c in features.names()])


def _loaded(kind, source):
    """A table of a kind from columns of other names and types, its titles normalised."""

    def query(spark, d):
        docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("no"), F.split("text", "\n", 2)[0].alias("line"), (F.col("n_chars") % 7).cast("string").alias("owner"))
        of = {"title_id": "owner" if kind in ("train", "actuals") else "no", "title": "line"}
        out = source(docs, mapping={name: (of.get(name, "no"), type_) for name, (_, type_) in titles.KINDS[kind].items()})
        return out.select(*[c for c in out.columns if c not in ("words", "n_grams")])

    return query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _closest(spark, sf_dir, 1)


def _normalize_pages(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", transform_title(F.regexp_extract("html", r"<title>([^<\n]*)</title>", 1)).alias("transformed_title"))


def _accuracy(spark, d):
    truth = _kept(_truth(spark, d), "title_id")
    test = cascade_test(spark, d, truth).persist()  # for the report and for the cascade
    actual = test.select("test_index", F.when(F.col("test_index") >= MADE, F.col("test_index") - MADE).otherwise(-1).alias("title_id"))
    return evaluate.accuracy_report(actual, cascade.generate_predictions(test, truth))


def _near(spark, d):
    test, truth = cascade_test(spark, d), _truth(spark, d)
    rest = matching.remaining(test, matching.exact_matches(test, truth))
    return matching.near_exact_matches(candidates.near_pairs(rest, candidates.build_index(truth)))


def _word_features(spark, d):
    truth = _truth(spark, d)
    pairs = _pairs(spark, d).join(features.word_counts(truth), "title_id")
    rich = features.word_features(pairs, frequency.number_of_titles(truth))
    zipped = rich.select("test_index", "title_id", F.posexplode(F.arrays_zip("lengths", "idfs", "ranks")).alias("pos", "x"))
    return zipped.select("test_index", "title_id", (F.col("pos") + 1).alias("pos"), F.col("x.lengths").alias("length"), F.round("x.idfs", 6).alias("idf"), F.round("x.ranks", 6).alias("rank"))


def _edit(name):
    def query(spark, d):
        out = _truth(spark, d).select("title_id", misspell.EDITS[name](F.col("transformed_title"), misspell.Dice(F.col("title_id"), DEFAULT.seed)).alias("made"))
        return out

    return query


def _round_trip(spark, d, compression="none"):
    """Test titles written as delimited text and read again."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/titles-{uuid.uuid4().hex}"
    titles.write_delimited(_test(spark, d).select("test_index", F.col("title").alias("name")), path, compression=compression)
    return titles.read_delimited(spark, path, "test").select("test_index", "title", "transformed_title")


def _model_predictions(spark, d):
    truth = _kept(_truth(spark, d), "title_id")
    index = candidates.build_index(truth)
    model = cascade.train_matcher(train_titles(spark, d, truth), truth, index=index)
    return cascade.generate_predictions(cascade_test(spark, d, truth), truth, model, index=index)


def _frozen_predictions(spark, d):
    truth = _kept(_truth(spark, d), "title_id")
    return cascade.generate_predictions(cascade_test(spark, d, truth), truth, frozen_model)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = lambda s, d: titles.first_lines(s, d)
    out = {
        "normalize_titles": lambda s, d: every(s, d).select("doc_id", "transformed_title"),
        "normalize_pages": _normalize_pages,
        "encode_titles": lambda s, d: every(s, d).select("doc_id", F.posexplode(encode_title(F.col("transformed_title"))).alias("i", "code")).select("doc_id", (F.col("i") + 1).cast("long").alias("pos"), "code"),
        "title_words": lambda s, d: every(s, d).select("doc_id", "number_of_words", F.posexplode("words").alias("pos", "word")),
        "title_ngrams": lambda s, d: every(s, d).select("doc_id", F.explode("n_grams").alias("g")),
        "word_document_frequency": lambda s, d: frequency.word_frequency(_truth(s, d)),
        "word_idf": lambda s, d: frequency.word_idf(_truth(s, d)).select("word", F.round("idf", 6).alias("idf")),
        "ngram_document_frequency": lambda s, d: frequency.n_gram_frequency(_truth(s, d)),
        "ngram_idf": lambda s, d: frequency.n_gram_weights(_truth(s, d)).select("g", "w"),
        "ngram_vocabulary_union": lambda s, d: frequency.vocabulary_union(_truth(s, d), _test(s, d)),
        "truth_idf_sums": lambda s, d: frequency.truth_sums(_truth(s, d), frequency.n_gram_weights(_truth(s, d))),
        "query_idf_sums": lambda s, d: frequency.query_sums(_test(s, d), frequency.n_gram_weights(_truth(s, d))),
        "jaccard_scores": lambda s, d: candidates.jaccard_scores(_test(s, d), candidates.build_index(_truth(s, d))),
        "closest_matches_topk": lambda s, d: _closest(s, d).withColumn("rn", F.col("rn").cast("long")),
        "closest_matches_positional": lambda s, d: candidates.closest_matches_positional(_test(s, d), candidates.build_index(_truth(s, d)), 10).withColumn("rn", F.col("rn").cast("long")),
        "exact_matches": lambda s, d: matching.exact_matches(_test(s, d), _truth(s, d)),
        "exact_matches_parts": lambda s, d: matching.exact_matches(titles.part_titles(s, d).filter("id % 10 = 0").withColumnRenamed("id", "test_index"), titles.part_titles(s, d).filter("id % 10 <> 0").withColumnRenamed("id", "title_id")),
        "remaining_after_exact": lambda s, d: matching.remaining(_test(s, d), matching.exact_matches(_test(s, d), _truth(s, d))).select("test_index", "transformed_title"),
        "not_found_anti": lambda s, d: matching.remaining(_test(s, d), matching.exact_matches(_test(s, d), _truth(s, d))).select("test_index"),
        "length_bound": lambda s, d: _pairs(s, d).select("test_index", "title_id", F.round(length_bound(F.col("title"), F.col("match")), 6).alias("bound")),
        "indel_ratio": lambda s, d: _pairs(s, d).select("test_index", "title_id", indel_ratio(F.col("title"), F.col("match")).alias("ratio"), indel_ratio_truncated(F.col("title"), F.col("match")).alias("truncated")),
        "token_sort_ratio": lambda s, d: _pairs(s, d).select("test_index", "title_id", token_sort_ratio(F.col("title"), F.col("match")).alias("ratio")),
        "near_exact_matches": _near,
        "unique_argmax": lambda s, d: matching.unique_argmax(s.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") / 50000).alias("total")), "o_custkey", "total"),
        "pair_features_basic": lambda s, d: features.basic_features(_pairs(s, d)).drop("title", "match"),
        "truth_word_counts": lambda s, d: features.word_counts(_truth(s, d)).select("title_id", F.posexplode("counts").alias("i", "df")).select("title_id", (F.col("i") + 1).alias("pos"), "df"),
        "pair_features_words": _word_features,
        "word_best_ratio": lambda s, d: features.matched_words(_pairs(s, d)).select("test_index", "title_id", F.posexplode("best").alias("i", "best")).select("test_index", "title_id", (F.col("i") + 1).alias("pos"), "best"),
        "reconstructed_ratio": lambda s, d: features.matched_words(_pairs(s, d)).select("test_index", "title_id", "rebuilt", "rebuilt_ratio"),
        "keyboard_neighbours": lambda s, d: misspell.neighbours(s),
        **{f"misspell_{name}": _edit(name) for name in misspell.EDITS},
        "generated_pairs": lambda s, d: training.generated_pairs(_truth(s, d)),
        "training_pairs": _training_pairs,
        "evaluation_split": lambda s, d: training.evaluation_split(_training_pairs(s, d).persist()),
        "weighted_log_loss": lambda s, d: _scored(s, d).select("o_orderkey", F.round(training.log_loss_gradient(F.col("p"), F.col("y")), 9).alias("gradient"), F.round(training.log_loss_hessian(F.col("p"), F.col("y")), 9).alias("hessian")),
        "custom_error": lambda s, d: evaluate.custom_error(_scored(s, d)),
        "class_ratio": lambda s, d: evaluate.class_ratio(_scored(s, d)),
        "error_matrix": lambda s, d: evaluate.error_matrix(_scored(s, d)),
        "final_output": lambda s, d: cascade.generate_predictions(cascade_test(s, d), _truth(s, d)),
        "accuracy_report": _accuracy,
        "single_title_search": lambda s, d: cascade.search_title(s, "The and attion to thenedble the anea, erinr thanea and more", _truth(s, d)),
        "delimited_round_trip": _round_trip,
        "delimited_gzip_round_trip": lambda s, d: _round_trip(s, d, "gzip"),
        "model_predictions": _model_predictions,
        "frozen_model_predictions": _frozen_predictions,
        "frozen_model_evaluation": _frozen_evaluation,
        "model_evaluation": _trained_evaluation,
        "pair_feature_table": _feature_table,
        "load_truth": _loaded("truth", titles.truth),
        "load_train": _loaded("train", titles.train),
        "load_test": _loaded("test", titles.test),
        "load_actuals": _loaded("actuals", lambda df, **o: titles.from_frame(df, "actuals", **o)),
        "area_under_curve": lambda s, d: evaluate.area_under_curve(_scored(s, d)).select(F.round("area", 9).alias("area")),
        "feature_importance": lambda s, d: evaluate.feature_importance(_model(s, d), s),
    }
    return out


def oracle_sql() -> dict[str, str]:
    return oracles.sql()
