"""Explicit schemas of the raw feeds and the clean tables. Nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructType,
)

_STRINGS = ArrayType(StringType())


def _table(**columns: DataType) -> StructType:
    schema = StructType()
    for name, data_type in columns.items():
        schema = schema.add(name, data_type)
    return schema


CATALOG_RAW = _table(
    publisher=StringType(), url=StringType(), app_name=StringType(), tags=_STRINGS,
    reviews_url=StringType(), specs=_STRINGS, early_access=BooleanType(), genres=_STRINGS,
    title=StringType(), release_date=StringType(), price=StringType(), id=StringType(),
    developer=StringType(),
)

REVIEWS_RAW = _table(
    user_id=StringType(),
    reviews=ArrayType(_table(
        funny=StringType(), posted=StringType(), last_edited=StringType(), item_id=StringType(),
        helpful=StringType(), recommend=BooleanType(), review=StringType(),
    )),
)

LIBRARIES_RAW = _table(
    user_id=StringType(), items_count=LongType(), steam_id=StringType(), user_url=StringType(),
    items=ArrayType(_table(
        item_id=StringType(), item_name=StringType(), playtime_forever=LongType(),
        playtime_2weeks=LongType(),
    )),
)

CATALOG = _table(
    id=LongType(), title=StringType(), developer=StringType(), genres=_STRINGS,
    price=DoubleType(), release_date=IntegerType(),
)

REVIEWS = _table(
    user_id=StringType(), item_id=LongType(), recommend=BooleanType(),
    sentiment_analysis=IntegerType(),
)

LIBRARIES = _table(
    user_id=StringType(), items_count=LongType(),
    items=ArrayType(_table(
        item_id=LongType(), item_name=StringType(), playtime_forever=LongType(),
        playtime_2weeks=LongType(),
    )),
)

# The library table as CSV carries its nested column as JSON text.
LIBRARIES_CSV = _table(user_id=StringType(), items_count=LongType(), items=StringType())

LEXICON = _table(token=StringType(), valence=DoubleType())
