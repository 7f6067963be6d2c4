"""Scans of the raw feeds and the clean tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

# One alternative per kind of token in a Python literal: "text", 'text', a bare word, the rest.
# Possessive loops keep the matcher from recursing on long texts.
_LITERAL_TOKENS = (
    r"""("(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+'|[A-Za-z_]++|[^A-Za-z_'"]++|['"])"""
)
_HEX_ESCAPE = r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})"
# An escape of eight digits, told from an escaped backslash before a capital U.
_WIDE_ESCAPE = r"(?<!\\)(?:\\\\)*\\U([0-9a-fA-F]{8})"


def _spread(rows: DataFrame, path: str) -> DataFrame:
    """Rows of a gzip feed spread evenly: one task reads a gzip file whatever its size.

    Files that can be split are read by many tasks and left as they are.
    """
    return rows.hint("rebalance") if path.endswith(".gz") else rows


def scan_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON Lines, gzip or plain; ``path`` ends in ``.gz`` if the files are gzip (``folder/*.gz``)."""
    return _spread(spark.read.schema(schema).json(path), path)


def scan_csv_gz(
    spark: SparkSession, path: str, schema: T.StructType, user_id: str | None = None
) -> DataFrame:
    """CSV with a header and quoted JSON columns; all rows of one user if one is given."""
    df = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return df.filter(F.col("user_id") == user_id) if user_id is not None else _spread(df, path)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Sentiment lexicon: tab-separated token and mean valence, further columns ignored."""
    fields = F.split("value", "\t")
    return (
        spark.read.text(path)
        .select(F.get(fields, F.lit(0)).alias("token"),
                F.get(fields, F.lit(1)).try_cast("double").alias("valence"))
        .filter(F.col("valence").isNotNull())
    )


def literal_to_json(line: Column) -> Column:
    """Rewrite a Python literal of dicts, lists, texts, numbers and constants as JSON text.

    The line is cut into tokens first, so a ``True`` inside a text stays as it is.
    """
    tokens = F.regexp_extract_all(line, F.lit(_LITERAL_TOKENS), F.lit(1))

    def to_surrogates(token: Column) -> Column:
        """``\\U`` escapes as JSON has them: the two 16-bit halves of the code point."""
        def one(text: Column, digits: Column) -> Column:
            code = F.conv(digits, 16, 10).cast("bigint")
            half = lambda n: F.concat(F.lit(r"\\u"), F.lpad(F.hex(n), 4, "0"))
            above = code - 0x10000
            pair = F.concat(
                half(F.shiftright(above, 10) + 0xD800), half(above.bitwiseAND(0x3FF) + 0xDC00)
            )
            escape = F.concat(F.lit(r"(?<!\\)((?:\\\\)*)\\U"), digits)
            return F.regexp_replace(
                text, escape, F.concat(F.lit("$1"), F.when(code < 0x10000, half(code)).otherwise(pair))
            )

        found = F.array_distinct(F.regexp_extract_all(token, F.lit(_WIDE_ESCAPE), F.lit(1)))
        return F.aggregate(found, token, one)

    def to_json_token(token: Column) -> Column:
        return (
            F.when(token == "True", "true")
            .when(token == "False", "false")
            .when(token == "None", "null")
            .when(token.contains("\\U"), to_surrogates(F.regexp_replace(token, _HEX_ESCAPE, "$1\\\\u00$2")))
            .when(token.contains("\\x"), F.regexp_replace(token, _HEX_ESCAPE, "$1\\\\u00$2"))
            .otherwise(token)
        )

    return F.array_join(F.transform(tokens, to_json_token), "")


def parse_literal_records(lines: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Parse literal lines into ``schema`` plus ``_corrupt_record``, which is NULL for good lines."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {
        "allowSingleQuotes": "true",
        "allowBackslashEscapingAnyCharacter": "true",
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT,
    }
    record = F.from_json(literal_to_json(F.col(value)), wide, options)
    return lines.select(record.alias("record")).select("record.*")


def scan_literal_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Text file with one Python literal per line (UTF-8); unreadable lines are kept, marked."""
    return parse_literal_records(_spread(spark.read.text(path), path), schema)
