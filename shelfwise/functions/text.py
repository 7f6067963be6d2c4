"""Text functions as native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_CASED = r"\p{IsUppercase}\p{IsLowercase}\p{Lt}"
_WORD_START = rf"(?<=[^{_CASED}])(?=[{_CASED}])"
# No character of any text, so the mark can be taken out again.
_MARK = "\ufdd0 "
SPACE = r"(?U)[\s\x1c-\x1f]+"


def capitalize(c: Column) -> Column:
    """First character upper case, the rest lower case."""
    return F.concat(F.initcap(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the others.

    ``initcap`` starts a word after a blank only; marks with a blank make it start one after a
    digit, an apostrophe or a hyphen as well.
    """
    marked = F.regexp_replace(c, _WORD_START, _MARK)
    return F.replace(F.initcap(marked), F.lit(_MARK), F.lit(""))


def trim_right(c: Column) -> Column:
    """Remove trailing white space of any kind (``rtrim`` removes blanks only)."""
    return F.regexp_replace(c, SPACE + "$", "")


def trim_left(c: Column) -> Column:
    return F.regexp_replace(c, "^" + SPACE, "")


def split_part(c: Column, separator: str, index: int) -> Column:
    """Part ``index`` (from 0) of ``c`` cut at a literal separator, NULL if there is none."""
    return F.get(F.split(c, re.escape(separator)), F.lit(index))


def words(c: Column) -> Column:
    """The non-blank words of a text."""
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.array_size(words(c))


def round_half_even(c: Column) -> Column:
    """Round to an integer, halves to the even neighbour."""
    return F.bround(c, 0).cast("int")


def format_percent(share: Column) -> Column:
    """A share (0 to 1) as a percent number with two decimals and its sign."""
    return F.concat(F.round(share * 100, 2).cast("string"), F.lit("%"))


def percent_text(part: Column, total: Column) -> Column:
    """``part`` of ``total`` as percent text; no part at all is written ``0%``."""
    return F.when(part == 0, F.lit("0%")).otherwise(format_percent(part / total))
