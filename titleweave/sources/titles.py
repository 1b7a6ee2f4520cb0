"""Reading and writing title tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleweave.config import DEFAULT, Config
from titleweave.functions.normalize import n_grams, number_of_words, transform_title, words

#: Internal name to (file column, type), for each kind of table.
TRUTH = {"title_id": ("company_id", "long"), "title": ("name", "string")}
TRAIN = {"train_index": ("train_index", "long"), "title": ("name", "string"), "title_id": ("company_id", "long")}
TEST = {"test_index": ("test_index", "long"), "title": ("name", "string")}
ACTUALS = {"test_index": ("test_index", "long"), "title_id": ("company_id", "long")}
#: How delimited text is read and written: quotes are doubled, blanks stay, an empty field is null and a quoted one an empty text.
FORMAT = {"quote": '"', "escape": '"', "charToEscapeQuoteEscaping": "\0", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: What the reader puts in place of a quoted empty field, for it would take "" for null.
EMPTY = "\0empty\0"
KINDS = {"truth": TRUTH, "train": TRAIN, "test": TEST, "actuals": ACTUALS}


def with_derived(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """df with transformed_title, words, number_of_words and n_grams; a null title has nulls."""
    return with_words(df.withColumn("transformed_title", transform_title(F.col("title"), config.max_characters, config.n_grams)), config)


def with_words(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """What with_derived() tells of normalised titles that are there."""
    t = F.col("transformed_title")
    return df.withColumns({"words": words(t), "number_of_words": number_of_words(t), "n_grams": F.when(t.isNotNull(), n_grams(t, config.n_grams))})


def from_frame(df: DataFrame, kind: str, mapping: dict[str, tuple[str, str]] | None = None, config: Config = DEFAULT) -> DataFrame:
    """Project, rename and cast any table of the given kind, and derive columns where it has titles."""
    expected = list(KINDS[kind])
    mapping = mapping or KINDS[kind]
    if list(mapping) != expected:
        raise ValueError(f"the mapping of {kind} must have the keys {expected}, not {list(mapping)}")
    out = df.select([F.col(f"`{column}`").cast(kind_).alias(name) for name, (column, kind_) in mapping.items()])
    return with_derived(out, config) if "title" in mapping else out


def read_delimited(spark: SparkSession, path: str, kind: str, mapping: dict[str, tuple[str, str]] | None = None, config: Config = DEFAULT) -> DataFrame:
    """Delimited text with a header, compressed or not."""
    raw = spark.read.options(**FORMAT, emptyValue=EMPTY).csv(path, sep=config.delimiter, header=True, multiLine=True)
    raw = raw.select([F.when(F.col(f"`{c}`") == EMPTY, "").otherwise(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    return from_frame(raw, kind, mapping, config)


def truth(source: DataFrame, **options) -> DataFrame:
    return from_frame(source, "truth", **options)


def train(source: DataFrame, **options) -> DataFrame:
    return from_frame(source, "train", **options)


def test(source: DataFrame, **options) -> DataFrame:
    return from_frame(source, "test", **options)


def single_title(spark: SparkSession, title: str, config: Config = DEFAULT) -> DataFrame:
    """A test table of one row, number 0."""
    if not title or not title.strip():
        raise ValueError("the title to search is empty")
    return with_derived(spark.createDataFrame([(0, title.strip())], "test_index long, title string"), config)


def write_delimited(df: DataFrame, path: str, order: str = "test_index", config: Config = DEFAULT, single_file: bool = False, compression: str = "none") -> None:
    """Sorted by order: a folder of parts in order, or one part, for results small enough to be a single file."""
    ordered = df.coalesce(1).sortWithinPartitions(order) if single_file else df.orderBy(order)
    ordered.write.options(**FORMAT).csv(path, sep=config.delimiter, header=True, mode="overwrite", compression=compression)


def first_lines(spark: SparkSession, sf_dir: str, config: Config = DEFAULT) -> DataFrame:
    """(doc_id, title, derived columns): the first line of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.split("text", "\n", 2)[0].alias("title"))
    return with_derived(docs, config)


def truth_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_lines(spark, sf_dir).filter("doc_id % 10 <> 0").withColumnRenamed("doc_id", "title_id")


def test_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_lines(spark, sf_dir).filter("doc_id % 10 = 0").withColumnRenamed("doc_id", "test_index")


def part_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_derived(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")))
