"""Document frequencies and fixed-point inverse document frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: IDF weights are whole millionths: sums are exact, whatever order they are added in.
SCALE = 1_000_000


def word_frequency(titles: DataFrame) -> DataFrame:
    """(word, df): titles that have the word."""
    return titles.select(F.explode_outer(F.array_distinct("words")).alias("word")).filter("word is not null").groupBy("word").agg(F.count("*").alias("df"))


def n_gram_frequency(titles: DataFrame) -> DataFrame:
    return titles.select(F.explode_outer("n_grams").alias("g")).filter("g is not null").groupBy("g").agg(F.count("*").alias("df"))


def number_of_titles(titles: DataFrame) -> int:
    return titles.filter("transformed_title is not null").count()


def idf(df: Column, n: int) -> Column:
    return F.log(F.lit(float(n)) / df)


def idf_weight(df: Column, n: int) -> Column:
    return F.round(idf(df, n) * SCALE).cast("long")


def n_gram_weights(titles: DataFrame, n: int | None = None) -> DataFrame:
    """(g, df, w) of a reference table."""
    n = number_of_titles(titles) if n is None else n
    return n_gram_frequency(titles).withColumn("w", idf_weight(F.col("df"), max(n, 1)))


def word_idf(titles: DataFrame) -> DataFrame:
    n = number_of_titles(titles)
    return word_frequency(titles).withColumn("idf", idf(F.col("df"), max(n, 1)))


def vocabulary_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(F.explode_outer("n_grams").alias("g")).filter("g is not null").union(b.select(F.explode_outer("n_grams").alias("g")).filter("g is not null")).distinct()


def truth_sums(truth: DataFrame, weights: DataFrame) -> DataFrame:
    """(title_id, tsum): total weight of each reference title's n-grams."""
    return truth.select("title_id", F.explode_outer("n_grams").alias("g")).filter("g is not null").join(weights, "g").groupBy("title_id").agg(F.sum("w").alias("tsum"))


def query_sums(queries: DataFrame, weights: DataFrame) -> DataFrame:
    """(test_index, qsum): likewise of queries, an n-gram that no reference title has weighing as much as the heaviest."""
    most = weights.agg(F.max("w")).first()[0] or 0
    return queries.select("test_index", F.explode_outer("n_grams").alias("g")).filter("g is not null").join(weights, "g", "left").groupBy("test_index").agg(F.sum(F.coalesce("w", F.lit(most))).alias("qsum"))
