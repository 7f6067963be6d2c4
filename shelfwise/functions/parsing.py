"""Release year and price from the texts of the raw catalog."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.text import words

# The wording of the feed that the cleaning rules look for.
UNDATED = r"(?i:soon)|TBA|Beta"
QUARTER = "Q1"
LONG_TEXT_YEAR = 2017
FREE_GENRE = "Free to Play"
STARTING_PRICES = {"Starting at $499.00": 499.0, "Starting at $449.00": 449.0}

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def try_numeric(c: Column) -> Column:
    """Text to double, NULL for anything that is not a plain number."""
    text = c.cast("string")
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def release_year_text(c: Column, long_text_year: int = LONG_TEXT_YEAR) -> Column:
    """What the layout rules leave of a release date, still as text.

    In order: the part before the first dash; nothing for an undated release; the third part
    between dots; a fixed year for more than two words; the second of two words, or the first if
    the second is the quarter.
    """
    head = F.substring_index(c, "-", 1)
    dated = F.when(~head.rlike(UNDATED), head)
    last = F.when(dated.contains("."), F.get(F.split(dated, r"\."), F.lit(2))).otherwise(dated)

    def pick(text: Column) -> Column:
        parts = words(text)
        second = F.get(parts, F.lit(1))
        return (
            F.when(F.array_size(parts) > 2, F.lit(str(long_text_year)))
            .when(
                text.contains(" "),
                F.when(second == QUARTER, F.get(parts, F.lit(0))).otherwise(second),
            )
            .otherwise(text)
        )

    # The one-element array binds the intermediate text to a name, so it is computed once.
    return F.get(F.transform(F.array(last), pick), F.lit(0))


def parse_release_year(c: Column, long_text_year: int = LONG_TEXT_YEAR) -> Column:
    """Release year as int; NULL where the text holds none."""
    return release_year_text(c, long_text_year).try_cast("int")


def parse_price(price: Column, genres: Column, tags: Column) -> Column:
    """Price as double; NULL only for a missing price of an item that is not free to play."""
    free = F.coalesce(F.array_contains(genres, FREE_GENRE), F.lit(False)) | F.coalesce(
        F.array_contains(tags, FREE_GENRE), F.lit(False)
    )
    known = F.coalesce(F.round(try_numeric(price), 2), F.lit(0.0))
    for text, value in STARTING_PRICES.items():
        known = F.when(price == text, F.lit(value)).otherwise(known)
    return F.when(price.isNotNull(), known).when(free, F.lit(0.0))
