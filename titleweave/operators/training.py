"""Labelled pairs, the evaluation split and the model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleweave.config import DEFAULT, GENERATED, NEGATIVE, POSITIVE, Config
from titleweave.functions.normalize import number_after_hash
from titleweave.operators.candidates import Index, closest_matches
from titleweave.operators.features import all_features, names, word_counts
from titleweave.operators.misspell import misspelled

MISSING = -1.0
#: A fitted pipeline, or any function from the feature columns' DataFrame to the probability of a match.
Model = PipelineModel | Callable[[DataFrame], Column]


def sampled_neighbours(train: DataFrame, index: Index, config: Config = DEFAULT) -> DataFrame:
    """(train_index, true_id, title_id): random ones of the closest matches; a positive row's own title is always one of them,
    in place of the last where there are enough without it.
    """
    rows = train.withColumnRenamed("title_id", "true_id").withColumnRenamed("train_index", "test_index")
    near = closest_matches(rows, index, config.top_n_predicting)
    order = Window.partitionBy("test_index").orderBy(number_after_hash(config.seed, "neighbour", F.col("test_index"), F.col("title_id")), "title_id")
    some = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= config.top_n_training)
    some = some.join(rows.select("test_index", "true_id"), "test_index").persist()  # read twice, and a search to make
    whole = Window.partitionBy("test_index")
    told = some.withColumn("has", F.max(F.col("title_id") == F.col("true_id")).over(whole))
    kept = told.filter(~((F.col("true_id") != config.not_found) & ~F.col("has") & (F.col("place") == config.top_n_training)))
    got = told.filter("has").select("test_index").distinct()
    forced = rows.filter(F.col("true_id") != config.not_found).join(got, "test_index", "left_anti").select("test_index", "true_id", F.col("true_id").alias("title_id"))
    return kept.select("test_index", "true_id", "title_id").unionByName(forced).withColumnRenamed("test_index", "train_index")


def latest_per_title(train: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Of positive rows that share a title_id, the one with the largest train_index."""
    none = F.col("title_id") == config.not_found
    last = Window.partitionBy("title_id", F.when(none, F.col("train_index"))).orderBy(F.col("train_index").desc())
    return train.filter("title_id is not null").withColumn("__n", F.row_number().over(last)).filter((F.col("__n") == 1) | none).drop("__n")


def generated_pairs(truth: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(title_id, title, truth_title): each long enough title beside a misspelling of it."""
    long_enough = truth.filter(F.length("transformed_title") >= config.least_generated_length).select("title_id", F.col("transformed_title").alias("truth_title"))
    return misspelled(long_enough, "truth_title", "title_id", "title", config).select("title_id", "title", "truth_title")


def training_pairs(train: DataFrame, truth: DataFrame, index: Index, config: Config = DEFAULT) -> DataFrame:
    """(kind, title, truth_title, title_id, target); title_id is the reference title's."""
    rows = latest_per_title(train.select("train_index", "title_id", "transformed_title"), config).persist()  # read several times, and dear to make
    near = sampled_neighbours(rows, index, config)
    a = rows.select("train_index", F.col("transformed_title").alias("title"))
    b = truth.select("title_id", F.col("transformed_title").alias("truth_title"))
    found = near.join(a, "train_index").join(b, "title_id")
    kind = F.when(F.col("true_id") == config.not_found, NEGATIVE).otherwise(POSITIVE)
    told = found.select(kind.alias("kind"), "title", "truth_title", "title_id", (F.col("true_id") == F.col("title_id")).cast("int").alias("target"))
    made = generated_pairs(truth, config).select(F.lit(GENERATED).alias("kind"), "title", "truth_title", "title_id", F.lit(1).alias("target"))
    return told.unionByName(made)


def evaluation_split(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """pairs with is_eval: of each kind exactly a fraction of all rows (or all there are), drawn by a hash of the pair.

    A count for each of 4,096 stretches of the hash tells which stretches are drawn whole; only the one that holds the
    last drawn row is ranked.
    """
    total = pairs.count()
    sizes = {GENERATED: int(total * config.evaluation_generated), NEGATIVE: int(total * config.evaluation_negative), POSITIVE: int(total * config.evaluation_positive)}
    roll = number_after_hash(config.seed, "evaluation", F.col("kind"), F.col("title"), F.col("truth_title"), F.col("title_id"))
    rolled = pairs.withColumn("__roll", roll).withColumn("__stretch", F.shiftright("__roll", 16))
    counts = rolled.groupBy("kind", "__stretch").agg(F.count("*").alias("__n"))
    below = Window.partitionBy("kind").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__below", F.coalesce(F.sum("__n").over(below), F.lit(0)))
    wanted = F.lit(0)
    for kind, n in sizes.items():
        wanted = F.when(F.col("kind") == kind, n).otherwise(wanted)
    placed = rolled.join(F.broadcast(counts), ["kind", "__stretch"]).withColumn("__wanted", wanted)
    last = (F.col("__below") < F.col("__wanted")) & (F.col("__below") + F.col("__n") > F.col("__wanted"))
    order = Window.partitionBy("kind", "__stretch").orderBy("__roll", "title", "truth_title", "title_id", "target")
    ranked = placed.filter(last).withColumn("is_eval", F.col("__below") + F.row_number().over(order) <= F.col("__wanted"))
    whole = placed.filter(~last).withColumn("is_eval", F.col("__below") + F.col("__n") <= F.col("__wanted"))
    return whole.unionByName(ranked).select(*pairs.columns, "is_eval")


def log_loss_gradient(p: Column, y: Column, beta: float = DEFAULT.false_positive_penalty) -> Column:
    return p * (beta + y - beta * y) - y


def log_loss_hessian(p: Column, y: Column, beta: float = DEFAULT.false_positive_penalty) -> Column:
    return p * (1 - p) * (beta + y - beta * y)


def feature_table(pairs: DataFrame, truth: DataFrame, n: int, config: Config = DEFAULT) -> DataFrame:
    """pairs(title, truth_title or match, title_id) with all features, missing ones as MISSING."""
    named = pairs.withColumnRenamed("truth_title", "match") if "match" not in pairs.columns else pairs
    rich = all_features(named.join(word_counts(truth, config.words), "title_id"), n, config.words)
    return rich.fillna(MISSING, names(config.words)).drop("counts")


def train_model(pairs: DataFrame, truth: DataFrame, n: int, config: Config = DEFAULT) -> PipelineModel:
    """Boosted trees on the pairs' features; is_eval rows decide when to stop. Negatives weigh as much as the penalty says,
    which makes the loss the weighted log-loss.
    """
    table = feature_table(pairs, truth, n, config).persist()
    try:
        return fit_model(table, config)
    finally:
        table.unpersist()


def fit_model(table: DataFrame, config: Config = DEFAULT) -> PipelineModel:
    """train_model() of a feature table that is there; it is read several times."""
    rows = table.withColumn("weight", F.when(F.col("target") == 1, 1.0).otherwise(config.false_positive_penalty)).withColumn("label", F.col("target").cast("double"))
    gather = VectorAssembler(inputCols=names(config.words), outputCol="features")
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxDepth=config.depth, stepSize=config.step, maxIter=config.rounds, seed=7, validationIndicatorCol="is_eval")
    return Pipeline(stages=[gather, trees]).fit(rows)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict(model: Model, features: DataFrame) -> DataFrame:
    """features with prediction, the probability of a match."""
    if not isinstance(model, PipelineModel):
        return features.withColumn("prediction", model(features))
    out = model.transform(features)
    return out.withColumn("__p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction").withColumnRenamed("__p", "prediction")
