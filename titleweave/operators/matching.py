"""Exact and near-exact matches, unique best rows and the final table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from titleweave.config import DEFAULT, Config
from titleweave.functions.similarity import length_bound, with_near_ratio


def with_exact(test: DataFrame, truth: DataFrame) -> DataFrame:
    """test with title_id of the reference row of an equal normalised title, the largest of several; null where there is none."""
    last = truth.filter("transformed_title is not null").groupBy("transformed_title").agg(F.max("title_id").alias("title_id"))
    return test.join(last, "transformed_title", "left")


def exact_matches(test: DataFrame, truth: DataFrame) -> DataFrame:
    """(test_index, title_id): equal normalised titles; of several reference rows the largest title_id. Null matches nothing."""
    return with_exact(test, truth).filter("title_id is not null").select("test_index", "title_id")


def remaining(test: DataFrame, matched: DataFrame) -> DataFrame:
    return test.join(matched.select("test_index"), "test_index", "left_anti")


def unique_argmax(df: DataFrame, key: str, value: str) -> DataFrame:
    """The row of each key with the highest value; no row where several have it. One window sort does both."""
    by = Window.partitionBy(key).orderBy(F.col(value).desc_nulls_last())
    ranked = df.withColumn("__rank", F.rank().over(by)).filter("__rank = 1")
    return ranked.withColumn("__many", F.count("*").over(Window.partitionBy(key))).filter("__many = 1").drop("__rank", "__many")


def with_titles(pairs: DataFrame, test: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs(test_index, title_id, ...) with both titles."""
    a = test.select("test_index", F.col("transformed_title").alias("title"))
    b = truth.select("title_id", F.col("transformed_title").alias("match"))
    return pairs.join(a, "test_index").join(b, "title_id")


def near_ratio(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """pairs(title, match, ...) whose ratio, or where it falls short that of the sorted words, is over the threshold, with it.
    Only pairs that may pass by their lengths are compared.
    """
    possible = pairs.filter(length_bound(F.col("title"), F.col("match")) >= config.ratio_threshold)
    return with_near_ratio(possible, config.ratio_threshold)


def near_exact_matches(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(test_index, title_id, ratio) of candidates with a ratio over the threshold, if one is the best alone."""
    good = near_ratio(pairs.select("test_index", "title_id", "title", "match"), config)
    return unique_argmax(good.select("test_index", "title_id", "ratio"), "test_index", "ratio")


def final_output(test: DataFrame, *predictions: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(title_id, test_index) of every test row: its own title_id where it has one, or that of the first
    prediction(test_index, title_id) that has the row, or not found. A prediction has each test_index once.
    """
    out = test.select("test_index", F.col("title_id") if "title_id" in test.columns else F.lit(None).cast("long").alias("title_id"))
    for p in predictions:
        own = p.select("test_index", F.col("title_id").alias("__own"))
        out = out.join(own, "test_index", "left").select("test_index", F.coalesce("title_id", "__own").alias("title_id"))
    return out.select(F.coalesce("title_id", F.lit(config.not_found).cast("long")).alias("title_id"), "test_index")
