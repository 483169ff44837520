"""Text expressions: whitespace rules, stems, content ids, reasoning removal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that Python's str.strip, \s and str.splitlines recognise,
# spelled out because Java's \s is ASCII only.
SPACE = (r"[ \t\n\x0B\f\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
         r"\x{202F}\x{205F}\x{3000}]")
SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                           0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"

# Answer letters and difficulty vocabulary.
LETTERS = "ABCDEFGH"
DIFFICULTIES = ("basic", "intermediate", "advanced", "expert")


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks.

    From both ends; a pattern would look at every character of the text.
    """
    return F.btrim(c, F.lit(SPACES))


def letter_at(index: Column) -> Column:
    """0-based index to answer letter; null when out of range."""
    return F.when((index >= 0) & (index < len(LETTERS)),
                  F.substring(F.lit(LETTERS), index + 1, F.lit(1)))


def letters_of(n: Column) -> Column:
    """The letters valid for an item with ``n`` choices."""
    return F.substring(F.lit(LETTERS), F.lit(1), n)


def stem(c: Column, length: int | None = None) -> Column:
    """Normalised text used for duplicate detection; whole, or its first ``length`` characters."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    return words if length is None else F.substring(words, 1, length)


def content_basis(fmt: Column, question: Column, choices: Column, prompt: Column) -> Column:
    return F.when(fmt == "mc", F.concat(question, F.lit("||"), F.array_join(choices, "|"))
                  ).otherwise(prompt)


def content_id(dimension: Column, difficulty: Column, basis: Column) -> Column:
    """``dimension_difficulty_hash``: stable across authoring reruns of the same content."""
    return F.concat_ws("_", dimension, difficulty, F.substring(F.sha2(basis, 256), 1, 10))


def without_reasoning(c: Column) -> Column:
    """Drop everything through the last closing think tag."""
    return strip(F.substring_index(c, "</think>", -1))


def without_fences(c: Column) -> Column:
    return F.regexp_replace(c, "```[a-zA-Z]*", "")


def utc(c: Column) -> Column:
    """UTC call stamp to TIMESTAMP; unparseable stamps are missing."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssX"))
