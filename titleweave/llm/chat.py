"""Chat formatting with Spark expressions only.

Turns are collected as structs and sorted; adjacent turns of one role become one block:

    user        [INST] text [SEP] text [/INST]
    assistant   <s> text [SEP] text </s>
    any other   [ROLE] role [SEP] text [SEP] text [/ROLE]

Inside texts and role names a control string gets a backslash after its first character; one that has backslashes there
already gets one more. So none stands in an escaped text, and taking one backslash away gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INNER = " [SEP] "
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\]|SEP\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|/?ROLE\]|SEP\])"
BLOCK_END = r"(?<= (?:\[/INST\]|</s>|\[/ROLE\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _opening(role: Column) -> Column:
    return F.when(role == "user", "[INST] ").when(role == "assistant", "<s> ").otherwise(F.concat(F.lit("[ROLE] "), escape(role), F.lit(INNER)))


def _closing(role: Column) -> Column:
    return F.when(role == "user", " [/INST]").when(role == "assistant", " </s>").otherwise(" [/ROLE]")


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss): one row per conversation; a null conv_id is one conversation too.

    loss: array<struct<from, to>>, the code points of each assistant text, escaped as it stands, without marks.
    Turns are sorted by turn (null first), then role, then text, so ties and repeated rows have one order; null roles and
    texts count as empty. Other columns are not read; no rows give no rows. A conversation is one output row, so its turns
    meet in one task, after a partial collection in each map task.
    """
    own = rows.select(F.col(f"`{conv_col}`").alias("conv_id"), F.struct(F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).alias("t"))
    turns = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    starts = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.element_at("turns", F.greatest(i, F.lit(1))).role != F.element_at("turns", F.greatest(i - 1, F.lit(1))).role))
    cut = turns.withColumn("starts", starts)

    def block(k: Column) -> Column:
        a = F.element_at("starts", k)
        b = F.coalesce(F.get("starts", k), F.size("turns") + 1)
        return F.struct(F.element_at("turns", a).role.alias("role"), F.transform(F.slice("turns", a, b - a), lambda t: escape(t.text)).alias("texts"))

    merged = cut.withColumn("blocks", F.transform(F.sequence(F.lit(1), F.size("starts")), block))
    body = F.transform("blocks", lambda b: F.concat(_opening(b.role), F.array_join(b.texts, INNER), _closing(b.role)))
    # what stands before, in and behind each text
    told = F.transform("blocks", lambda b: F.transform(b.texts, lambda t, k: F.struct(F.when(k == 0, F.length(_opening(b.role))).otherwise(len(INNER)).cast("long").alias("before"), F.length(t).cast("long").alias("n"), F.when(k == F.size(b.texts) - 1, F.length(_closing(b.role))).otherwise(0).cast("long").alias("behind"), (b.role == "assistant").alias("learnt"))))
    sized = merged.withColumn("told", F.flatten(told)).withColumn("sizes", F.transform("told", lambda x: x.before + x.n + x.behind))
    spans = F.zip_with("told", "ends", lambda x, end: F.when(x.learnt, F.struct((end - x.behind - x.n).alias("from"), (end - x.behind).alias("to"))))
    return _with_ends(sized).select("conv_id", F.array_join(body, "").alias("formatted"), F.filter(spans, lambda s: s.isNotNull()).alias("loss"))


def _grown(sizes: Column, first: Column, after: bool) -> Column:
    """For each of some sizes, first and those before it added up, and its own too where after."""
    return F.aggregate(sizes, F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out")), lambda s, x: F.struct((s.at + x).alias("at"), F.array_append(s.out, s.at + x if after else s.at).alias("out")), lambda s: s.out)


def _with_ends(df: DataFrame, step: int = 256) -> DataFrame:
    """df(sizes array<bigint>) with ends: the sums up to each size. A growing array is copied whole each time, so it is grown in
    stretches; they are columns, as an expression in a lambda would be worked out for each element.
    """
    cut = df.withColumn("parts", F.transform(F.sequence(F.lit(1), F.size("sizes"), F.lit(step)), lambda i: F.slice("sizes", i, step)))
    zero = F.lit(0).cast("long")
    firsts = _grown(F.transform("parts", lambda p: F.aggregate(p, zero, lambda s, x: s + x)), zero, False)
    return cut.withColumn("ends", F.flatten(F.zip_with("parts", firsts, lambda p, first: _grown(p, first, True))))


def parse_chats(chats: DataFrame) -> DataFrame:
    """chats with turns array<struct<role, text>>, read back from the formatted string alone."""

    def turns_of(b: Column) -> Column:
        named = ~(b.startswith("[INST] ") | b.startswith("<s> "))
        before = F.when(b.startswith("<s> "), 4).otherwise(7)
        after = F.when(b.startswith("<s> "), 5).otherwise(8)
        parts = F.transform(F.split(F.substring(b, before + 1, F.length(b) - before - after), r" \[SEP\] ", -1), unescape)
        role = F.when(b.startswith("[INST] "), F.lit("user")).when(b.startswith("<s> "), F.lit("assistant"))
        return F.when(named, F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda t: F.struct(F.element_at(parts, 1).alias("role"), t.alias("text")))).otherwise(F.transform(parts, lambda t: F.struct(role.alias("role"), t.alias("text"))))

    blocks = F.filter(F.split("formatted", BLOCK_END, -1), lambda b: b != "")
    return chats.withColumn("turns", F.flatten(F.transform(blocks, turns_of)))


def loss_text(chats: DataFrame) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")))), "")


def report(rows: DataFrame, **columns) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all but conv_id read back from the output."""
    chats = parse_chats(format_chats(rows, **columns))
    lost = chats.withColumn("loss_text", loss_text(chats))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return lost.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
