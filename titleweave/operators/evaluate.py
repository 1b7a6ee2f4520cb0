"""Errors, counts and importances."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleweave.config import DEFAULT, Config
from titleweave.operators.features import names


def custom_error(scored: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(custom_error) of scored(p, y): missed matches plus the penalty for each wrong one."""
    hit = F.col("p") > config.probability_threshold
    return scored.agg(F.sum(F.when(~hit & (F.col("y") == 1), 1.0).when(hit & (F.col("y") == 0), config.false_positive_penalty).otherwise(0.0)).alias("custom_error"))


def error_matrix(scored: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(true_positives, true_negatives, false_positives, false_negatives) of scored(p, y)."""
    hit, y = F.col("p") > config.probability_threshold, F.col("y")
    return scored.agg(F.count_if(hit & (y == 1)).alias("true_positives"), F.count_if(~hit & (y == 0)).alias("true_negatives"), F.count_if(hit & (y == 0)).alias("false_positives"), F.count_if(~hit & (y == 1)).alias("false_negatives"))


def class_ratio(scored: DataFrame) -> DataFrame:
    return scored.agg((F.count_if(F.col("y") == 0) / F.nullif(F.count_if(F.col("y") == 1), F.lit(0))).alias("class_ratio"))


def accuracy_report(actual: DataFrame, predicted: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Four counts and the custom error of predicted against actual(test_index, title_id), one row.

    Raises where a test row has no prediction.
    """
    a = actual.select("test_index", F.col("title_id").alias("a"))
    both = a.join(predicted.select("test_index", F.col("title_id").alias("p")), "test_index", "left")
    none = config.not_found
    out = both.agg(
        F.count_if(F.col("p").isNull()).alias("without"),
        F.count_if((F.col("p") != none) & (F.col("p") == F.col("a"))).alias("correctly_matched"),
        F.count_if((F.col("p") != none) & (F.col("p") != F.col("a"))).alias("incorrectly_matched"),
        F.count_if((F.col("p") == none) & (F.col("a") == none)).alias("correctly_not_found"),
        F.count_if((F.col("p") == none) & (F.col("a") != none)).alias("incorrectly_not_found"),
    )
    checked = out.withColumn("without", F.when(F.col("without") > 0, F.raise_error(F.concat(F.col("without").cast("string"), F.lit(" test rows have no prediction")))).otherwise(F.lit(0)))
    return checked.select((F.col("correctly_matched") + F.col("without")).alias("correctly_matched"), "incorrectly_matched", "correctly_not_found", "incorrectly_not_found", (F.col("incorrectly_not_found") + config.false_positive_penalty * F.col("incorrectly_matched")).alias("custom_error"))


def feature_importance(model: PipelineModel, spark, config: Config = DEFAULT) -> DataFrame:
    """(feature, share), the most important first."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    rows = spark.createDataFrame(list(zip(names(config.words), values, strict=True)), "feature string, gain double")
    return rows.withColumn("share", F.col("gain") / F.sum("gain").over(Window.partitionBy())).select("feature", "share").orderBy(F.col("share").desc(), "feature")


def _by_value(scored: DataFrame, *by: str) -> DataFrame:
    """(by, p, up, down, below): how many rows of scored(p, y) have each p, with y = 1 and y = 0, and how many with y = 0 a lower one.
    Only distinct values of p meet in one task.
    """
    counts = scored.groupBy(*by, "p").agg(F.count_if(F.col("y") == 1).alias("up"), F.count_if(F.col("y") == 0).alias("down"))
    below = Window.partitionBy(*by).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("below", F.coalesce(F.sum("down").over(below), F.lit(0)))


def _area() -> Column:
    pairs = F.sum("up").cast("double") * F.sum("down")
    return (F.sum(F.col("up") * (F.col("below") + F.col("down") / 2)) / F.nullif(pairs, F.lit(0.0))).alias("area")


def area_under_curve(scored: DataFrame, *by: str) -> DataFrame:
    """(by, area) of scored(p, y): the share of (y = 1, y = 0) pairs that p orders right, ties counting half; null where one kind
    is missing.
    """
    return _by_value(scored, *by).groupBy(*by).agg(_area())


def evaluation(scored: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The error matrix, custom error and area under the curve of scored(is_eval, p, y), for evaluation rows and the others. All
    come of the counts of each p, so that what is dear to score is scored once.
    """
    hit = F.col("p") > config.probability_threshold
    told = lambda where, n: F.sum(F.when(where, F.col(n)).otherwise(0))
    wrong, missed = told(hit, "down"), told(~hit, "up")
    error = (missed + config.false_positive_penalty * wrong).alias("custom_error")
    return _by_value(scored, "is_eval").groupBy("is_eval").agg(told(hit, "up").alias("true_positives"), told(~hit, "down").alias("true_negatives"), wrong.alias("false_positives"), missed.alias("false_negatives"), error, _area())
