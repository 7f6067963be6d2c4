"""Native expressions on texts that several operators share."""

from __future__ import annotations

import string
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What lies between words: ASCII white space, or everything in ASCII but letters and digits.
SPACES = r"[\x20\x09-\x0D]+"
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; the quick way serves texts that are ASCII throughout."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def split_words(text: Column) -> Column:
    """The words of a text between ASCII white space, in order; none where it is NULL or empty.

    Blanks and line breaks, nearly all there is, are split without a pattern.
    """
    body = F.coalesce(text, F.lit(""))
    rare = reduce(or_, [F.contains(body, F.lit(c)) for c in "\t\x0b\x0c\r"])
    plain = F.split(F.replace(body, F.lit("\n"), F.lit(" ")), " ")
    return F.array_remove(F.when(rare, F.split(body, SPACES)).otherwise(plain), "")


def split_alphanumeric(text: Column) -> Column:
    """The words of a text between ASCII characters that are neither letters nor digits."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NON_WORD), "")


def window_hashes(words: str | Column, size: int) -> Column:
    """A 64-bit hash of every window of ``size`` words, in order; none if there are fewer words.

    It is made of the words' own hashes, so that a word is hashed once.
    """
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.element_at(F.transform(F.array(hashed), lambda h: F.transform(
        F.slice(h, F.lit(1), F.greatest(F.size(h) - (size - 1), F.lit(0))),
        lambda first, i: F.xxhash64(first, *[F.get(h, i + k) for k in range(1, size)]),
    )), 1)


def row_key(*columns: Column) -> Column:
    """128 bits that tell a row by its content, NULLs included; equal rows have equal keys."""
    half = [F.hex(F.xxhash64(F.lit(seed), *columns)) for seed in (1, 2)]
    return F.concat(F.lpad(half[0], 16, "0"), F.lpad(half[1], 16, "0"))


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its columns computed once, where they stand.

    The optimizer moves a filter below the projection it reads, writing out the projected expressions
    anew; it does not move one below a generator.
    """
    return df.select(F.inline_outer(F.array(F.struct("*"))))
