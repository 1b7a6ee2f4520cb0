"""Line dedup by winnowing over line hashes, with DataFrame functions only.

Of each RUN consecutive lines that aren't blank the least hash, the rightmost of equal ones, is a fingerprint; a line of LONG
characters or more is one by itself. So two documents that share RUN lines, or a long one, are sure to share a fingerprint.
There is one row for each fingerprint. Rows are joined by the fingerprint's line; where it stands at more than one place, it
is extended both ways, to the runs that selected it, by comparing the lines beside it; of equal runs the one at the least
place stays, and the lines of later ones are deleted. Overlapping runs make up longer ones.

Lines are told apart by two 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleweave.llm.common import materialize, packed, unpacked

#: Lines of a run. Characters of a line that is a run by itself: 51 words with a blank between have no fewer.
RUN, LONG = 2, 101
BLANK = r"^[ \t\r]*$"


def _row_key(text: Column) -> Column:
    return F.xxhash64(text)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, long: int = LONG) -> DataFrame:
    """(doc_id, text_key, j, line_1, line_2, runs): each fingerprint, the hashes of its line, and the runs that selected it.

    j counts the lines that aren't blank. Of a run: its first line's j, its first and last place among all lines, and hashes
    of where the fingerprint stands in it and of the lines to both sides.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("text is not null")
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), (F.length(x) >= long).alias("long"), x.rlike(BLANK).alias("blank"))), lambda x: ~x.blank)
    cut = own.select("doc_id", _row_key(F.col("text")).alias("text_key"), lines.alias("lines")).withColumn("n", F.size("lines")).filter("n > 0")
    none = F.array().cast("array<int>")

    def least(s: Column) -> Column:
        """The place of the least hash of the run from s on."""
        return -F.array_min(F.transform(F.slice("lines", s + 1, run), lambda x, k: F.struct(x.h.alias("h"), (-(s + k)).alias("at"))))["at"]

    picked = cut.withColumn("picked", F.when(F.col("n") >= run, F.transform(F.sequence(F.lit(0), F.col("n") - run), least)).otherwise(none))
    alone = F.filter(F.transform("lines", lambda x, j: F.when(x.long, j)), lambda j: j.isNotNull())
    marked = picked.withColumn("marks", F.array_distinct(F.concat("picked", alone)))

    def over(j: Column, s: Column) -> Column:
        """The run from s on, over the fingerprint at j."""
        sides = lambda name: F.transform(F.filter(F.slice("lines", s + 1, run), lambda x, k: s + k != j), lambda x: x[name])
        return F.struct(s.alias("s"), F.get("lines", s).i.alias("from"), F.get("lines", s + (run - 1)).i.alias("to"), F.xxhash64(j - s, sides("h")).alias("sides_1"), F.xxhash64(j - s, sides("g")).alias("sides_2"))

    def one(j: Column) -> Column:
        line = F.get("lines", j)
        starts = F.filter(F.sequence(F.greatest(j - (run - 1), F.lit(0)), F.greatest(j, F.lit(0))), lambda s: F.get("picked", s) == j)
        by_itself = F.when(line.long, F.array(F.struct(j.alias("s"), line.i.alias("from"), line.i.alias("to"), F.lit(-1).cast("long").alias("sides_1"), F.lit(-1).cast("long").alias("sides_2"))))
        runs = F.transform(starts, lambda s: over(j, s))
        return F.struct(j.alias("j"), line.h.alias("line_1"), line.g.alias("line_2"), F.when(line.long, F.concat(runs, by_itself)).otherwise(runs).alias("runs"))

    return marked.select("doc_id", "text_key", F.explode(F.transform("marks", one)).alias("r")).select("doc_id", "text_key", "r.*")


def later_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, long: int = LONG) -> DataFrame:
    """(doc_id, text_key, from, to) of each run that stands at a smaller (doc_id, first line), null first, too."""
    found = materialize(fingerprints(docs, id_col, text_col, run, long), "lines")
    place, line = F.struct("doc_id", "j"), ["line_1", "line_2"]
    shared = found.groupBy(line).agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select(line)
    extended = found.join(shared, line, "left_semi").select("doc_id", "text_key", *line, F.inline("runs"))
    start, sides = F.struct("doc_id", "s"), ["sides_1", "sides_2"]
    first = extended.groupBy(line + sides).agg(F.min(start).alias("first"), F.max(start).alias("last")).filter("first <> last").select(*line, *sides, "first")
    return extended.join(first, line + sides).filter(start > F.col("first")).select("doc_id", "text_key", "from", "to")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, long: int = LONG) -> DataFrame:
    """docs with later repeated runs of lines, and later repeated long lines, deleted from the text, and the blank lines within
    runs; columns stay.

    Lines are parted by newlines and compared as they are, all of them; blank ones (spaces, tabs, returns) don't count.
    Null texts stay null; a text with all lines deleted is empty; repeated rows share a place, so none is later than the
    other.
    """
    made = _cut(docs, id_col, text_col, run, long)
    return unpacked(made, docs, **{text_col: F.col("text")})


def _cut(docs: DataFrame, id_col: str, text_col: str, run: int, long: int) -> DataFrame:
    """(row, text, n_lines, n_deleted): each row as a struct, and what is left of its text."""
    gone = later_runs(docs, id_col, text_col, run, long).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("from", "to")).alias("gone"))
    text = F.col("row").getField(text_col).cast("string")
    own = packed(docs).withColumn("id", F.col("row").getField(id_col)).withColumn("key", _row_key(text))
    joined = own.join(gone, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left").select("row", F.array_distinct(F.flatten(F.transform("gone", lambda r: F.sequence(r["from"], r["to"])))).alias("gone"))
    cut = joined.withColumn("lines", F.split(text, "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    n = F.when(text.isNull(), 0).otherwise(F.size("lines"))
    return cut.select("row", F.when(F.col("gone").isNull(), text).otherwise(kept).alias("text"), n.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, long: int = LONG) -> DataFrame:
    """(doc_id, n_lines, n_deleted, kept_sha256), one row per row of docs; null counts as a text without lines."""
    made = _cut(docs, id_col, text_col, run, long)
    return made.select(F.col("row").getField(id_col).alias("doc_id"), "n_lines", F.when(F.col("n_deleted") < 0, 0).otherwise(F.col("n_deleted")).cast("long").alias("n_deleted"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
