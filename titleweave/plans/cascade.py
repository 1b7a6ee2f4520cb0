"""The matching cascade: exact, near-exact, model; what is left is not found."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleweave.config import DEFAULT, Config
from titleweave.operators.candidates import Index, build_index, closest_pairs, near_pairs
from titleweave.operators.evaluate import evaluation
from titleweave.operators.matching import exact_matches, final_output, near_exact_matches, near_ratio, remaining, unique_argmax, with_exact
from titleweave.operators.training import Model, evaluation_split, feature_table, predict, train_model, training_pairs
from titleweave.sources.titles import single_title


def labelled_pairs(train: DataFrame, truth: DataFrame, config: Config = DEFAULT, index: Index | None = None) -> DataFrame:
    """Training pairs with is_eval, the evaluation rows set aside. Kept, as drawing and fitting read them several times."""
    return evaluation_split(training_pairs(train, truth, index or build_index(truth, config.n_grams), config).persist(), config)


def train_matcher(train: DataFrame, truth: DataFrame, config: Config = DEFAULT, index: Index | None = None) -> PipelineModel:
    """Build labelled pairs, set aside the evaluation rows and fit the model."""
    index = index or build_index(truth, config.n_grams)
    return train_model(labelled_pairs(train, truth, config, index), truth, index.n, config)


def evaluate_model(model: Model, pairs: DataFrame, truth: DataFrame, n: int, config: Config = DEFAULT) -> DataFrame:
    """(true_positives, true_negatives, false_positives, false_negatives, custom_error, area) of a model, one row for the
    evaluation rows of pairs (is_eval) and one for the others.
    """
    return evaluate_table(model, feature_table(pairs, truth, n, config), config)


def evaluate_table(model: Model, table: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """evaluate_model() of a feature table that is there."""
    scored = predict(model, table).select("is_eval", F.col("prediction").alias("p"), F.col("target").alias("y"))
    return evaluation(scored, config)


def model_matches(pairs: DataFrame, truth: DataFrame, model: Model, n: int, config: Config = DEFAULT) -> DataFrame:
    """(test_index, title_id, prediction) of candidates over the probability threshold, if one is the best alone."""
    scored = predict(model, feature_table(pairs, truth, n, config))
    good = scored.filter(F.col("prediction") > config.probability_threshold)
    return unique_argmax(good.select("test_index", "title_id", "prediction"), "test_index", "prediction")


def generate_predictions(test: DataFrame, truth: DataFrame, model: Model | None = None, config: Config = DEFAULT, index: Index | None = None) -> DataFrame:
    """(title_id, test_index): every test row once. Each stage sees only rows that none before it has matched; repeated rows
    are searched once and each give a row.

    Without a model the cascade ends after the near-exact stage. With one, candidates of all that is left are searched; the
    near-exact matches, which tell what that is, are kept.
    """
    index = index or build_index(truth, config.n_grams)
    exact = with_exact(test, truth).select("test_index", "transformed_title", "title_id").persist()
    rest = exact.filter("title_id is null").distinct()
    near = near_exact_matches(near_pairs(rest, index, config.top_n_predicting, config.ratio_threshold), config)
    found = [near]
    if model is not None:
        found[0] = near = near.persist()
        pairs = closest_pairs(remaining(rest, near), index, config.top_n_predicting)
        found.append(model_matches(pairs, truth, model, index.n, config))
    return final_output(exact, *found, config=config)


def search_title(spark: SparkSession, title: str, truth: DataFrame, model: Model | None = None, config: Config = DEFAULT, index: Index | None = None) -> DataFrame:
    """(title_id, match, prediction) of the best reference title, by the first stage that has one: exact (1.0), near-exact
    (ratio / 100), then the best candidate by model or, without one, by likeness; no threshold holds for that one, and of equal
    ones the larger title_id wins. No row where nothing is shared. The index may be kept from call to call.
    """
    test = single_title(spark, title, config)
    index = index or build_index(truth, config.n_grams)
    pairs = closest_pairs(test, index, config.top_n_predicting)
    exact = exact_matches(test, truth).join(truth.select("title_id", F.col("transformed_title").alias("match")), "title_id").select("title_id", "match", F.lit(1.0).alias("prediction"), F.lit(1).alias("stage"))
    near = unique_argmax(near_ratio(pairs, config), "test_index", "ratio").select("title_id", "match", (F.col("ratio") / 100.0).alias("prediction"), F.lit(2).alias("stage"))
    scored = pairs.withColumnRenamed("score", "prediction") if model is None else predict(model, feature_table(pairs, truth, index.n, config))
    last = scored.select("title_id", "match", "prediction", F.lit(3).alias("stage"))
    every = exact.unionByName(near).unionByName(last)
    return every.orderBy("stage", F.col("prediction").desc(), F.col("title_id").desc()).limit(1).select("title_id", "match", "prediction")
