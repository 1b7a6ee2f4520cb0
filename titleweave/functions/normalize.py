"""Title normalisation, words and character n-grams as Column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from titleweave.config import DEFAULT

ALPHABET = "- abcdefghijklmnopqrstuvwxyz0123456789"
SPACES = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f"


@lru_cache(1)
def ascii_parts() -> tuple[str, str]:
    """Every non-ASCII character whose canonical decomposition has an ASCII part, and those parts."""
    source, target = [], []
    for code in range(128, sys.maxunicode + 1):
        part = unicodedata.normalize("NFD", chr(code)).encode("ascii", "ignore").decode() if unicodedata.decomposition(chr(code)) else ""
        if part:
            source.append(chr(code))
            target.append(part)
    if any(len(x) != 1 for x in target):
        raise ValueError("a decomposition has several ASCII characters")
    return "".join(source), "".join(target)


def transform_title(title: Column, max_characters: int = DEFAULT.max_characters, least: int = DEFAULT.n_grams) -> Column:
    """Accents off, other non-ASCII dropped, lower case, hyphens to spaces, only letters, digits and white space, spaces
    collapsed and trimmed, cut, trimmed again. Texts shorter than least before the cut are padded with 0 on the left.
    """
    source, target = ascii_parts()
    plain = F.lower(F.regexp_replace(F.translate(title, source, target), r"[^\x00-\x7f]", ""))
    kept = F.regexp_replace(F.translate(plain, "-", " "), r"[^a-z0-9 \t\n\x0B\f\r\x1c-\x1f]", "")
    whole = F.btrim(F.regexp_replace(kept, " +", " "), F.lit(SPACES))
    cut = F.btrim(F.substring(whole, 1, max_characters), F.lit(SPACES))
    return F.when(F.length(whole) < least, F.lpad(whole, least, "0")).otherwise(cut)


def words(transformed: Column) -> Column:
    return F.split(transformed, r"[ \t\n\x0B\f\r\x1c-\x1f]+")


def number_of_words(transformed: Column) -> Column:
    return F.size(words(transformed))


def n_grams(transformed: Column, n: int = DEFAULT.n_grams) -> Column:
    """Distinct character n-grams; none for a text shorter than n. No lambda, in which a text would be worked out for each."""
    return F.array_distinct(F.regexp_extract_all(transformed, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def encode_title(transformed: Column) -> Column:
    """The place of each character in ALPHABET; -1 for one that isn't there."""
    return F.transform(F.split(transformed, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def number_after_hash(seed: str, op: str, *keys: Column) -> Column:
    """A number from 0 to 2**28 - 1 that depends on the seed, the operation and the keys alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(op), *[k.cast("string") for k in keys]).cast("binary")), 1, 7), 16, 10).cast("long")
