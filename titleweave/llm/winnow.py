"""Document fingerprints by winnowing, with DataFrame functions only.

Each K consecutive code points of a text are hashed; of each WINDOW consecutive hashes the least is kept, the rightmost of
equal ones, with its position. Two texts that share K + WINDOW - 1 consecutive code points share a mark, wherever they stand.

Array functions would work out each character by interpreted lambdas. So a text is cut into stretches of STRETCH windows,
each with what follows as far as its last window reaches; a stretch is a row, and each of its hashes and minima a column of
compiled code. Hashes of K code points are put together from those of fewer by rotating and xor, minima of WINDOW from those
of fewer, the width doubling each time. The rows of a text stay in its task and are gathered there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleweave.llm.common import materialize, unused

#: Code points of a hash, those of the first hashes, hashes of a window.
K, FIRST, WINDOW = 16, 4, 16
#: Consecutive documents that are worked on together.
BLOCK = 64
#: Windows of a stretch. More than 100 columns are compiled in many small methods, which is what makes them fast.
STRETCH, CUT = 128, 16
REACH = K + WINDOW - 2
#: By how many bits the first half of a hash of so many code points is turned.
TURN = {8: 13, 16: 29}


def _with_stretches(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """df with a column for each of texts: its stretches in order, each with what follows; none for an empty text.

    Two steps, so that a text isn't cut again for each stretch.
    """
    cut = df.withColumns({name: F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)) for name, text in texts.items()})
    beside = lambda c: F.zip_with(c, F.slice(c, 2, F.greatest(F.size(c), F.lit(1))), lambda a, b: F.concat(a, F.coalesce(F.substring(b, 1, REACH), F.lit(""))))
    return cut.withColumns({name: beside(F.col(name)) for name in texts})


def _stretch_marks(rows: DataFrame, kept: list[str]) -> DataFrame:
    """(kept columns, i, marks array<long>) of rows(kept columns, i, s): marks of the i-th stretch s of a text.

    A mark's high 56 bits are the hash, its low byte 255 less its place in the stretch. A text of fewer than K code points
    has one hash over all of them; fewer than WINDOW hashes are one window; null has no marks.
    """
    carried = [f"`{c}`" for c in kept] + ["i"]  # not text, but for one stretch of it
    n = STRETCH + REACH
    df = rows.selectExpr(*carried, "length(s) n", "(shiftleft(xxhash64(s), 8) | 255) whole", *[f"substring(s, {b * CUT + 1}, {CUT + FIRST - 1}) p{b}" for b in range(-(-n // CUT))])
    carried += ["n", "whole"]
    width, n = FIRST, n - FIRST + 1
    df = df.selectExpr(*carried, *[f"xxhash64(substring(p{j // CUT}, {j % CUT + 1}, {FIRST})) h{width}_{j}" for j in range(n)])
    while width < K:
        old, width = width, 2 * width
        n -= old
        turned = lambda x: f"(shiftleft({x}, {TURN[width]}) | shiftrightunsigned({x}, {64 - TURN[width]}))"  # noqa: B023, E731
        df = df.selectExpr(*carried, *[f"{turned(f'h{old}_{j}')} ^ h{old}_{j + old} h{width}_{j}" for j in range(n)])
    df = df.selectExpr(*carried, *[f"if(n >= {j + K}, shiftleft(h{K}_{j}, 8) | {255 - j}, {2**63 - 1}L) m1_{j}" for j in range(n)])
    width = 1
    while width < WINDOW:
        old, width = width, 2 * width
        n -= old
        df = df.selectExpr(*carried, *[f"least(m{old}_{j}, m{old}_{j + old}) m{width}_{j}" for j in range(n)])
    every = ", ".join(f"m{width}_{j}" for j in range(n))
    windows = f"least(greatest(n - {REACH}, if(i = 0, 1, 0)), {STRETCH})"
    some = f"if(n is null, cast(array() as array<bigint>), if(n < {K} and i = 0, array(whole), array_distinct(slice(array({every}), 1, {windows}))))"
    return df.selectExpr(*carried[:-2], f"{some} marks")


def append_marks(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """df with out array<struct<hash, position>>: the marks of text_col in order of position, none for a null or empty text.

    Fewer than K code points have one hash over all of them; fewer than WINDOW hashes are one window. No prefix, no cap.
    """
    no, s, row = unused(df, "__no"), unused(df, "__s"), unused(df, "__row")
    packed = df.select(F.struct([F.col(f"`{c}`") for c in df.columns]).alias(row), F.monotonically_increasing_id().alias(no))
    cut = _with_stretches(packed, {s: F.coalesce(F.col(row).getField(text_col).cast("string"), F.lit(""))})
    rows = cut.select(no, F.posexplode_outer(s).alias("i", "s")).withColumn("i", F.coalesce("i", F.lit(0)))
    placed = F.transform("marks", lambda m: F.struct((F.col("i").cast("long") * STRETCH + 255 - m.bitwiseAND(255)).alias("position"), F.shiftright(m, 8).alias("hash")))
    found = _stretch_marks(rows, [no]).select(no, placed.alias("marks")).groupBy(no).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("marks")))).alias("marks"))
    joined = packed.join(found, no)
    ordered = F.transform("marks", lambda m: F.struct(m.hash.alias("hash"), m.position.alias("position")))
    return joined.select([F.col(row).getField(c).alias(c) for c in df.columns if c != out] + [ordered.alias(out)])


def hashes(marks: Column) -> Column:
    """The set of hashes of marks from append_marks()."""
    return F.array_distinct(F.transform(marks, lambda m: m.hash))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two hash sets; 1 for two empty ones."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def name(hash_set: Column) -> Column:
    """A fingerprint as 16 hex digits."""
    return F.lpad(F.lower(F.hex(F.xxhash64(F.sort_array(hash_set)))), 16, "0")


def blocks(ids: DataFrame) -> DataFrame:
    """(doc_id, block, at, extra) of ids(doc_id distinct): runs of BLOCK consecutive ids, null first, and each id's place.

    The first id of each block stands, extra, at the end of the block before too, that of the first block at the end of the
    last one. Ids are dealt by ranges; only one row of each range meets in one task.
    """
    ranges = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.col("doc_id").asc_nulls_first()
    dealt = materialize(ids.repartitionByRange(ranges, first).withColumn("range", F.spark_partition_id()), "ranges")
    placed = dealt.withColumn("at", F.row_number().over(Window.partitionBy("range").orderBy(first)) - 1)
    number = lambda r, at: F.shiftleft(r.cast("long"), 40) + F.floor(at / BLOCK)
    ends = dealt.groupBy("range").agg((F.count("*") - 1).alias("end"))
    whole = Window.orderBy("range")  # one row for each range
    last = number(F.col("range"), F.col("end"))
    before = ends.withColumn("b", F.coalesce(F.lag(last).over(whole), F.last(last).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).select("range", "b")
    known = placed.join(F.broadcast(before), "range").withColumn("own", number(F.col("range"), F.col("at")))
    place = lambda block, at, extra: F.struct(block.alias("block"), at.cast("long").alias("at"), F.lit(extra).alias("extra"))
    own, again = place(F.col("own"), F.col("at"), False), place(F.when(F.col("at") == 0, F.col("b")).otherwise(F.col("own") - 1), F.lit(1 << 62), True)
    return known.select("doc_id", F.explode(F.when(F.col("at") % BLOCK == 0, F.array(own, again)).otherwise(F.array(own))).alias("p")).select("doc_id", "p.*")


def _hash_lists(df: DataFrame, key: list[str], stretches: str, about: Column) -> DataFrame:
    """(key, about, parts array<struct<i, hashes>>) of df: the hashes of each of its stretches. key tells rows apart and begins
    with the columns by which df is partitioned, so nothing moves; about goes with one stretch only.
    """
    rows = df.withColumn("about", about).select(*key, "about", F.posexplode_outer(stretches).alias("i", "s"))
    once = rows.withColumns({"i": F.coalesce("i", F.lit(0)), "about": F.when(F.coalesce("i", F.lit(0)) == 0, F.col("about"))})
    marked = _stretch_marks(once, [*key, "about"])
    part = F.struct("i", F.transform("marks", lambda m: F.shiftright(m, 8)).alias("hashes"))
    return marked.groupBy(*key).agg(F.first("about", ignorenulls=True).alias("about"), F.collect_list(part).alias("parts"))


def _set(parts: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(parts, lambda p: p.hashes)))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of whole texts, and of each with its last quarter replaced by the beginning of the next document's.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per row of docs.
    Null texts count as empty. The next document is that of the next larger doc_id (after the largest: the least; null
    is least); rows that share a doc_id share a next one, and the least of their texts stands for them. Other columns are
    not read; no rows give no rows.

    Documents meet their next ones in blocks of consecutive ids, so each text is worked out once, and of its edited text
    the windows that don't lie before the edit.
    """
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    places = blocks(base.select("doc_id").distinct()).withColumnRenamed("doc_id", "key")
    dealt = base.join(places, F.col("doc_id").eqNullSafe(F.col("key"))).drop("key").repartition("block").withColumn("no", F.monotonically_increasing_id())
    key = ["block", "at", "no"]
    own = _hash_lists(_with_stretches(dealt, {"stretches": F.col("text")}), key, "stretches", F.struct("doc_id", "text", "extra"))
    known = own.select(*key, "about.*", "parts", _set(F.col("parts")).alias("own"))
    order = Window.partitionBy("block").orderBy("at", "text")
    follows = known.withColumn("after", F.when(F.lead("at").over(order) > F.col("at"), F.lead(F.struct("text", "own")).over(order)))
    met = follows.withColumn("after", F.first("after", ignorenulls=True).over(Window.partitionBy("block", "at"))).filter(~F.col("extra"))
    quarter = F.floor(F.length("text") / 4).cast("int")
    sized = met.withColumns({"kept": F.length("text") - quarter, "head": F.expr("substring(after.text, 1, cast(floor(length(text) / 4) as int))")})
    sized = sized.withColumn("same", F.greatest(F.floor((F.col("kept") - REACH) / STRETCH), F.lit(0)).cast("int"))
    told = sized.withColumns({"sha": F.sha2(F.expr("concat(substring(text, 1, kept), head)").cast("binary"), 256), "before": _set(F.filter("parts", lambda p: p.i < F.col("same")))})
    tail = _with_stretches(told, {"stretches": F.expr(f"concat(substring(text, same * {STRETCH} + 1, kept - same * {STRETCH}), head)")})
    about = F.struct("doc_id", F.length("text").cast("long").alias("n_chars"), "sha", "own", "before", F.col("after.own").alias("next"))
    done = _hash_lists(tail, key, "stretches", about)
    sets = done.select("about.*", F.array_distinct(F.concat("about.before", _set(F.col("parts")))).alias("edited"))
    return sets.select("doc_id", "n_chars", F.col("sha").alias("edited_sha256"), name(F.col("own")).alias("fingerprint"), name(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))
