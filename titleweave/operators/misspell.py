"""Misspelling titles the way fingers do, with hashes of a seed and a key for dice: the same on any partitioning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleweave.config import DEFAULT, Config
from titleweave.functions.normalize import number_after_hash, transform_title

ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbn")
#: Where each letter lies; m lies on n.
KEYBOARD = {c: (x, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)} | {"m": (5, 2)}


def keyboard(spark) -> DataFrame:
    return spark.createDataFrame([(c, x, y) for c, (x, y) in sorted(KEYBOARD.items())], "letter string, x int, y int")


def neighbours(spark) -> DataFrame:
    """(letter, neighbour) of letters at a distance of 1 at most."""
    a, b = keyboard(spark), keyboard(spark).select(F.col("letter").alias("neighbour"), F.col("x").alias("u"), F.col("y").alias("v"))
    apart = F.sqrt(F.pow(F.col("x") - F.col("u"), F.lit(2)) + F.pow(F.col("y") - F.col("v"), F.lit(2)))
    return a.join(F.broadcast(b), (F.col("letter") != F.col("neighbour")) & (apart <= 1)).select("letter", "neighbour")


def neighbour_strings() -> dict[str, str]:
    return {a: "".join(b for b in sorted(KEYBOARD) if a != b and abs(KEYBOARD[a][0] - KEYBOARD[b][0]) + abs(KEYBOARD[a][1] - KEYBOARD[b][1]) <= 1) for a in sorted(KEYBOARD)}


NEAR = neighbour_strings()


class Dice:
    def __init__(self, key: Column, seed: str):
        self.key, self.seed = key, seed

    def __call__(self, op: str, sides: Column | int) -> Column:
        return F.pmod(number_after_hash(self.seed, op, self.key), F.lit(sides) if isinstance(sides, int) else F.greatest(sides, F.lit(1)))


def _char(text: Column, i: Column) -> Column:
    return F.substring(text, i, F.lit(1))


def _places(text: Column, fits) -> Column:
    return F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), fits)


def _at(text: Column, places: Column, roll: Column, change) -> Column:
    return F.when(F.size(places) < 1, text).otherwise(change(F.get(places, roll.cast("int"))))


def _before(text: Column, p: Column) -> Column:
    return F.substring(text, F.lit(1), p - 1)


def _from(text: Column, p: Column) -> Column:
    return F.substring(text, p, F.length(text))


def remove_letter(text: Column, dice: Dice) -> Column:
    places = _places(text, lambda i: _char(text, i) != " ")
    return _at(text, places, dice("remove_letter", F.size(places)), lambda p: F.concat(_before(text, p), _from(text, p + 1)))


def _neighbour(letter: Column, roll: Column) -> Column:
    near = neighbour_strings()
    table = F.create_map(*[F.lit(x) for pair in near.items() for x in pair])
    options = F.element_at(table, letter)
    return _char(options, (F.pmod(roll, F.length(options)) + 1).cast("int"))


def _letters(text: Column) -> Column:
    return _places(text, lambda i: _char(text, i).between("a", "z"))


def add_letter(text: Column, dice: Dice) -> Column:
    places = _letters(text)
    return _at(text, places, dice("add_letter", F.size(places)), lambda p: F.concat(_before(text, p), _neighbour(_char(text, p), dice("add_letter_which", 1 << 28)), _from(text, p)))


def replace_letter(text: Column, dice: Dice) -> Column:
    places = _letters(text)
    return _at(text, places, dice("replace_letter", F.size(places)), lambda p: F.concat(_before(text, p), _neighbour(_char(text, p), dice("replace_letter_which", 1 << 28)), _from(text, p + 1)))


def add_space(text: Column, dice: Dice) -> Column:
    inside = lambda i: (i > 1) & (i < F.length(text)) & (_char(text, i) != " ") & (_char(text, i - 1) != " ") & (_char(text, i + 1) != " ")
    places = _places(text, inside)
    return _at(text, places, dice("add_space", F.size(places)), lambda p: F.concat(_before(text, p), F.lit(" "), _from(text, p)))


def remove_space(text: Column, dice: Dice) -> Column:
    places = _places(text, lambda i: _char(text, i) == " ")
    return _at(text, places, dice("remove_space", F.size(places)), lambda p: F.concat(_before(text, p), _from(text, p + 1)))


def swap_word(text: Column, dice: Dice) -> Column:
    parts = F.split(text, " ")
    a, b = dice("swap_word", F.size(parts)).cast("int"), dice("swap_word_with", F.size(parts)).cast("int")
    return F.array_join(F.transform(parts, lambda w, i: F.when(i == a, F.get(parts, b)).when(i == b, F.get(parts, a)).otherwise(w)), " ")


EDITS = {"remove_letter": remove_letter, "add_letter": add_letter, "replace_letter": replace_letter, "add_space": add_space, "remove_space": remove_space, "swap_word": swap_word}


def misspell_text(text: str, key: str, seed: str) -> str:
    """One or two of {word swap, letter in or out}, {letter replaced}, {space in or out}, in any order, before normalising.

    The same dice as the single edits above.
    """
    from hashlib import md5

    roll = lambda op: int(md5(f"{seed}|{op}|{key}".encode()).hexdigest()[:7], 16)
    near = NEAR

    def places(x: str, op: str) -> list[int]:
        if op == "remove_letter":
            return [i for i, c in enumerate(x) if c != " "]
        if op == "remove_space":
            return [i for i, c in enumerate(x) if c == " "]
        if op == "add_space":
            return [i for i, (a, b, c) in enumerate(zip(x, x[1:], x[2:], strict=False), 1) if a != " " != b and c != " "]
        return [i for i, c in enumerate(x) if "a" <= c <= "z"]

    def edit(x: str, op: str) -> str:
        if op == "swap_word":
            words = x.split(" ")
            a, b = roll(op) % len(words), roll("swap_word_with") % len(words)
            words[a], words[b] = words[b], words[a]
            return " ".join(words)
        some = places(x, op)
        if not some:
            return x
        i = some[roll(op) % len(some)]
        if op in ("remove_letter", "remove_space"):
            return x[:i] + x[i + 1 :]
        if op == "add_space":
            return x[:i] + " " + x[i:]
        options = near[x[i]]
        new = options[roll(op + "_which") % len(options)]
        return x[:i] + new + x[i + (op == "replace_letter") :]

    groups = [["swap_word", "add_letter", "remove_letter"][roll("first") % 3], "replace_letter", ["add_space", "remove_space"][roll("third") % 2]]
    first = roll("order") % 3
    out = edit(text, groups[first])
    return out if roll("edits") % 2 == 0 else edit(out, groups[(first + 1 + roll("order_next") % 2) % 3])


def misspelled(df: DataFrame, text_col: str, key_col: str, out: str, config: Config = DEFAULT) -> DataFrame:
    """df with a misspelling of text_col that depends on the seed and key_col alone; null for null."""
    seed = config.seed

    def made(text: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else misspell_text(t, k, seed) for t, k in zip(text, key, strict=True)], dtype=object)

    wrong = F.pandas_udf(made, T.StringType()).asNondeterministic()  # so called: never run twice for one row
    rough = df.withColumn("__rough", wrong(F.col(text_col), F.col(key_col).cast("string")))
    return rough.withColumn(out, transform_title(F.col("__rough"), config.max_characters, config.n_grams)).drop("__rough")
