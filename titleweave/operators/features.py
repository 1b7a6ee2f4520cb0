"""The 66 features of a pair of titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleweave.config import DEFAULT
from titleweave.functions.similarity import indel_ratio_truncated, word_matches
from titleweave.operators.frequency import idf, word_frequency

BASIC = ["title_chars", "truth_chars", "title_words", "truth_words", "ratio", "rebuilt_ratio"]


def names(limit: int = DEFAULT.words) -> list[str]:
    return BASIC + [f"{kind}_{i}" for kind in ("best", "length", "idf", "rank") for i in range(1, limit + 1)]


def _count_words(t: Column) -> Column:
    return F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1


def basic_features(pairs: DataFrame) -> DataFrame:
    """pairs(title, match) with lengths, numbers of words and the truncated ratio."""
    a, b = F.col("title"), F.col("match")
    return pairs.withColumns({"title_chars": F.length(a), "truth_chars": F.length(b), "title_words": _count_words(a), "truth_words": _count_words(b), "ratio": indel_ratio_truncated(a, b)})


def word_counts(truth: DataFrame, limit: int = DEFAULT.words) -> DataFrame:
    """(title_id, counts): document frequency of each of a title's first words, in order."""
    every = truth.select("title_id", F.posexplode(F.slice("words", 1, limit)).alias("pos", "word"))
    return every.join(word_frequency(truth), "word").groupBy("title_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "df"))), lambda x: x.df).alias("counts"))


def word_features(pairs: DataFrame, n: int, limit: int = DEFAULT.words) -> DataFrame:
    """pairs(match, counts) with arrays lengths, idfs and ranks of the first words. Ranks divide by the number of all words."""
    parts = F.slice(F.split("match", " "), 1, limit)
    out = pairs.withColumn("lengths", F.transform(parts, lambda w: F.length(w))).withColumn("idfs", F.transform("counts", lambda d: idf(d, n)))
    return out.withColumn("ranks", F.transform("idfs", lambda x: 1 + (F.array_max("idfs") - x) / _count_words(F.col("match"))))


def matched_words(pairs: DataFrame, limit: int = DEFAULT.words) -> DataFrame:
    """pairs(title, match) with best (ratios of the first words) and the ratio of the title rebuilt from their matches."""
    out = pairs.withColumn("__m", word_matches(F.col("title"), F.col("match"), limit))
    return out.withColumn("best", F.col("__m.ratios")).withColumn("rebuilt", F.col("__m.rebuilt")).drop("__m").withColumn("rebuilt_ratio", indel_ratio_truncated(F.col("rebuilt"), F.col("match")))


def all_features(pairs: DataFrame, n: int, limit: int = DEFAULT.words) -> DataFrame:
    """pairs(title, match, counts, ...) with a column for each feature, null where a title has no such word."""
    rich = matched_words(word_features(basic_features(pairs), n, limit), limit)
    wide = {f"{kind}_{i}": F.get(array, F.lit(i - 1)).cast("double") for kind, array in (("best", "best"), ("length", "lengths"), ("idf", "idfs"), ("rank", "ranks")) for i in range(1, limit + 1)}
    return rich.withColumns(wide).withColumns({c: F.col(c).cast("double") for c in BASIC}).drop("best", "lengths", "idfs", "ranks", "rebuilt")
