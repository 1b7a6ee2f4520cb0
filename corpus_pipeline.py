"""From raw documents to token ids in five stages; each works on the rows that the one before it kept.

STAGES: (name, function) in order. A function takes (spark, docs, sf_dir) and returns a DataFrame: the columns of
documents, but for the last stage, which returns doc_id, n_tokens, ids_sha256 and decoded_sha256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleweave.llm import bpe, decontam, langid, linededup, simhash
from titleweave.llm.common import discard, table, unused, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or that no language explains better than all others together, go."""
    return langid.reject_unknown(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; so do documents that had a text and have none left. n_chars follows the text."""
    had = unused(docs, "__had")
    cut = linededup.dedup_lines(docs.withColumn(had, F.coalesce(F.length("text") > 0, F.lit(False))))
    return _counted(cut.filter(~F.col(had) | (F.length("text") > 0)).drop(had), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least doc_id."""
    return simhash.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; the others lose the passages that are hit."""
    return _counted(decontam.clean(docs, table(spark, sf_dir, "benchmark")), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text that is left and decode it again."""
    return bpe.round_trip(docs)


def _counted(df: DataFrame, like: DataFrame) -> DataFrame:
    if "n_chars" not in like.columns:
        return df
    kind = dict(like.dtypes)["n_chars"]
    n = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind))
    return df.withColumn("n_chars", n).select([F.col(f"`{c}`") for c in like.columns])


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("BPE encoding and decoding", tokens),
]

#: The first stage is a learnt model, which SQL can't express; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents; each one's rows are written to the shared folder as Parquet and read again.

    What a stage reads and what it has written on the way goes when its own rows are there.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{k + 1}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
