"""Helpers shared by the text operators: tables, shared storage, batched Python over whole rows."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows and bytes of text that one Python step holds at a time. A longer single text is a step of its own.
STEP_ROWS, STEP_BYTES = 500, 1 << 20


_held: tuple = ()


def held(kind: str, key, build: Callable):
    """build(), kept in a Python worker for tasks to come. A worker keeps one such thing: another one takes its place, so
    memory doesn't add up from stage to stage.
    """
    global _held
    if _held[:2] != (kind, key):
        _held = ()
        _held = (kind, key, build())
    return _held[2]


def trim() -> None:
    """Give memory that a Python worker has freed back to the system, for a worker outlives its tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def packed(df: DataFrame) -> DataFrame:
    """df as one column named row, so that no name beside it can clash."""
    return df.select(F.struct([F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame, like: DataFrame, **changed) -> DataFrame:
    return df.select([changed.get(c, F.col("row").getField(c)).alias(c) for c in like.columns])


def unused(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local session gets a temporary one and
    a cluster, whose executors wouldn't see that, an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not jsc.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="titleweave-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/titleweave/{label}-{uuid.uuid4().hex}"


#: Spark's setting by which the shuffle files of an execution go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage and survives lost executors.

    The write's shuffle files go as soon as it is over; nothing else reads them.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._titleweave_path = path
    if (made := getattr(_making, "tables", None)) is not None:
        made.append(out)
    return out


_making = threading.local()


def written(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """materialize(make(), label); the tables that make() has written on the way go, as nothing reads them any more."""
    before, _making.tables = getattr(_making, "tables", None), []
    try:
        out = materialize(make(), label)
        for other in _making.tables[:-1]:
            discard(other)
    finally:
        _making.tables = before
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the files behind a table from materialize() that nothing reads any more."""
    path = getattr(df, "_titleweave_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def texts_in(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and text columns, under fixed names, so that other columns can neither clash nor be read."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def steps(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of at most STEP_ROWS rows and, but for a single row, STEP_BYTES of text."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= STEP_ROWS or size + n > STEP_BYTES):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield batch.slice(start)


def append_columns(df: DataFrame, make: Callable[[], Callable[[pa.Array], list]], fields: list[tuple[str, T.DataType]], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with columns computed from its text column, row by row, in Arrow batches.

    make() runs once per task and returns a function from a binary Arrow array of texts to the new columns.
    All rows stay, nulls and repeats included. An input column that has a new column's name is replaced.
    keep: the input columns wanted besides (default: all).
    """
    new = {name for name, _ in fields}
    names = [c for c in (df.columns if keep is None else keep) if c not in new]
    extra = [] if text_col in names else [text_col]
    source = df.select([F.col(f"`{c}`") for c in names + extra])
    schema = T.StructType([f for f in source.schema.fields if f.name in names] + [T.StructField(n, t) for n, t in fields])
    at, types = (names + extra).index(text_col), [to_arrow_type(t) for _, t in fields]
    out_names = names + [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for whole in batches:
            for batch in steps(whole, at):
                made = fn(batch.column(at).cast(pa.binary()))
                columns = [batch.column(i) for i in range(len(names))]
                columns += [x if isinstance(x, pa.Array) and x.type == t else (x.cast(t) if isinstance(x, pa.Array) else pa.array(x, type=t)) for x, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=out_names)
            trim()

    return source.mapInArrow(run, schema)
