"""The provided tables in the shape of catalog, reviews, libraries and raw feeds.

Each adapter has a twin in SQL, given as a common table expression of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_YEAR = 1995


class Tables:
    """Adapters over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def texts(self, name: str) -> DataFrame:
        """A table of texts."""
        return self.read(name)

    def catalog(self) -> DataFrame:
        """One item per part; the words of its name and its type are its genres."""
        genres = F.concat(F.split("p_name", " "), F.array("p_type"))
        return self.read("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("title"),
            F.col("p_brand").alias("developer"),
            F.array_distinct(genres).alias("genres"),
            F.col("p_retailprice").alias("price"),
            (F.lit(FIRST_YEAR) + F.col("p_size") % 7).cast("int").alias("release_date"),
        )

    def releases(self) -> DataFrame:
        """One catalog row per order line, a tax of zero playing the price of a free item."""
        lines = self.read("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            "l_partkey",
            F.year("l_shipdate").alias("release_date"),
            F.col("l_tax").alias("price"),
        )
        part = self.read("part").select("p_partkey", F.col("p_brand").alias("developer"))
        return lines.join(part, lines.l_partkey == part.p_partkey).select(
            "id", "developer", "release_date", "price"
        )

    def user_lines(self) -> DataFrame:
        """Order lines with the customer as user."""
        orders = self.read("orders").select(
            "o_orderkey", F.col("o_custkey").cast("string").alias("user_id")
        )
        lines = self.read("lineitem")
        return lines.join(orders, lines.l_orderkey == orders.o_orderkey).drop("o_orderkey")

    @staticmethod
    def _recommend() -> Column:
        return F.col("l_returnflag") != "R"

    @staticmethod
    def _sentiment() -> Column:
        cents = F.round(F.col("l_discount") * 100)
        return F.when(cents < 3, 0).when(cents <= 7, 1).otherwise(2)

    def reviews(self) -> DataFrame:
        return self.user_lines().select(
            "user_id",
            F.col("l_partkey").alias("item_id"),
            self._recommend().alias("recommend"),
            self._sentiment().alias("sentiment_analysis"),
        )

    def plays(self) -> DataFrame:
        """(user_id, item_id, item_name, playtime_forever) and the key of the order line."""
        part = self.read("part").select("p_partkey", F.col("p_name").alias("item_name"))
        lines = self.user_lines()
        return lines.join(part, lines.l_partkey == part.p_partkey).select(
            "user_id", F.col("l_partkey").alias("item_id"), "item_name",
            F.col("l_quantity").cast("bigint").alias("playtime_forever"),
            "l_orderkey", "l_linenumber",
        )

    def libraries(self) -> DataFrame:
        """One record per order, of at most eight lines, for the user who placed it."""
        part = self.read("part").select("p_partkey", F.col("p_name").alias("item_name"))
        lines = self.read("lineitem")
        item = F.struct(
            F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("item_id"), "item_name",
            F.col("l_quantity").cast("bigint").alias("playtime_forever"),
            F.lit(0).cast("bigint").alias("playtime_2weeks"),
        )
        part_of_order = F.floor(F.col("l_linenumber") / 8).alias("part_of_order")
        records = (
            lines.join(part, lines.l_partkey == part.p_partkey)
            .groupBy("l_orderkey", part_of_order)
            .agg(F.array_sort(F.collect_list(item)).alias("items"))
        )
        orders = self.read("orders").select(
            "o_orderkey", F.col("o_custkey").cast("string").alias("user_id")
        )
        return records.join(orders, records.l_orderkey == orders.o_orderkey).select(
            "user_id",
            F.size("items").cast("bigint").alias("items_count"),
            F.transform("items", lambda i: i.dropFields("line")).alias("items"),
        )

    def libraries_raw(self) -> DataFrame:
        return self.libraries().select(
            "user_id", "items_count",
            F.col("user_id").alias("steam_id"),
            F.concat(F.lit("/users/"), F.col("user_id")).alias("user_url"),
            F.transform(
                "items", lambda i: i.withField("item_id", i["item_id"].cast("string"))
            ).alias("items"),
        )

    def interactions(self) -> DataFrame:
        """The wide table straight from the order lines, the ship year as release year."""
        item = self.read("part").select(
            "p_partkey",
            F.col("p_name").alias("item_name"),
            F.array_distinct(F.concat(F.split("p_name", " "), F.array("p_type"))).alias("genres"),
            F.col("p_retailprice").alias("price"),
            F.col("p_brand").alias("developer"),
        )
        lines = self.user_lines()
        return lines.join(item, lines.l_partkey == item.p_partkey).select(
            "user_id",
            F.col("l_partkey").alias("item_id"),
            self._recommend().cast("int").alias("recommend"),
            self._sentiment().alias("sentiment_analysis"),
            "item_name",
            F.col("l_quantity").cast("bigint").alias("playtime_forever"),
            "genres",
            F.year("l_shipdate").alias("release_date"),
            "price",
            "developer",
        )

    def ratings(self) -> DataFrame:
        """One rating per user and item: the best one given."""
        rows = self.interactions()
        rating = (F.col("recommend") + F.col("sentiment_analysis")).cast("double")
        return rows.groupBy("user_id", "item_id").agg(F.max(rating).alias("rating"))

    def catalog_raw(self) -> DataFrame:
        """A messy catalog out of the orders: repeated and missing ids, dates and prices in mixed
        layouts, missing genres and developers."""
        k = F.col("o_orderkey")
        year = F.year("o_orderdate").cast("string")
        priority = F.col("o_orderpriority")
        return self.read("orders").select(
            F.when(k % 6 == 0, None).otherwise(F.concat(F.lit(" studio "), priority, F.lit("  "))).alias("publisher"),
            F.concat(F.lit("/item/"), F.lpad(k.cast("string"), 12, "0")).alias("url"),
            F.concat(F.lit("item "), k.cast("string")).alias("app_name"),
            F.when(k % 10 == 0, None)
            .when(k % 10 == 5, F.array(F.lit("Free to Play"), priority))
            .otherwise(F.array(F.lit("Tagged"), priority)).alias("tags"),
            F.concat(F.lit("/reviews/"), k.cast("string")).alias("reviews_url"),
            F.array(priority).alias("specs"),
            (k % 2 == 0).alias("early_access"),
            F.when(k % 5 == 0, None)
            .when(k % 5 == 1, F.array(F.lit("Free to Play"), F.lit("Indie")))
            .otherwise(F.array(F.lit("Action"), priority)).alias("genres"),
            F.concat(F.lit("title "), k.cast("string")).alias("title"),
            F.when(k % 9 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
            .when(k % 9 == 1, F.date_format("o_orderdate", "dd.MM.yyyy"))
            .when(k % 9 == 2, F.concat(F.lit("Jan "), year))
            .when(k % 9 == 3, F.concat(year, F.lit(" Q1")))
            .when(k % 9 == 4, F.lit("Coming Soon"))
            .when(k % 9 == 5, F.lit("TBA"))
            .when(k % 9 == 6, F.lit("Not out yet ever"))
            .when(k % 9 == 7, F.concat(year, F.lit(" Q2"))).alias("release_date"),
            F.when(k % 7 == 0, F.lit(None).cast("string"))
            .when(k % 7 == 1, F.lit("Free"))
            .when(k % 7 == 2, F.lit("Starting at $499.00"))
            .when(k % 7 == 3, F.lit("Starting at $449.00"))
            .when(k % 7 == 4, F.lit("Starting at $9.00"))
            .otherwise(F.format_string("%.3f", F.floor(F.col("o_totalprice")) + (k % 8) * 0.125))
            .alias("price"),
            F.when(k % 11 == 0, None).otherwise(F.floor(k / 2).cast("string")).alias("id"),
            F.when(k % 4 == 0, None)
            .otherwise(F.concat(F.lower(F.col("o_orderstatus")), F.lit("-box games "))).alias("developer"),
        )

    def spoken(self, table: str, *keys: str) -> DataFrame:
        """Texts of a table with some frequent words turned into modifiers."""
        text = F.col("text")
        for old, new in SPOKEN_WORDS:
            text = F.replace(text, F.lit(f" {old} "), F.lit(f" {new} "))
        return self.texts(table).select(*keys, text.alias("text"))

    def lexicon(self) -> DataFrame:
        rows = ", ".join(f"('{w}', {v}D)" for w, v in LEXICON)
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS l(token, valence)")


# Frequent words of the texts, turned into words the scoring rules react to.
SPOKEN_WORDS = [
    ("of", "not"), ("in", "VERY"), ("to", "slightly"), ("was", "isn't"), ("for", "but"),
    ("by", "never so"), ("a", "least"), ("und", "kind of"), ("des", "really"), ("with", "the bomb"), ("from", "kiss of death"),
    ("as", "yeah right"), ("der", "sort of"),
]
# Valences of words that do occur in the texts.
LEXICON = [
    ("the", 0.4), ("and", -0.7), ("that", 1.1), ("is", -0.4), ("it", 0.9), ("on", -1.3),
    ("as", 0.5), ("with", -0.6), ("de", 0.3), ("la", -0.5), ("der", 0.6), ("die", -0.4),
    ("kind", 1.5), ("not", -0.2), ("le", 0.7), ("en", -0.8),
]


def ctes(*names: str) -> str:
    """``WITH`` clause of the named adapters and those they read."""
    wanted: list[str] = []

    def add(name: str) -> None:
        needs, _ = SQL[name]
        for need in needs:
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{name} AS ({SQL[name][1]})" for name in wanted) + "\n"


_GENRES = "list_distinct(list_concat(string_split(p_name, ' '), [p_type]))"
_RECOMMEND = "l_returnflag <> 'R'"
_SENTIMENT = (
    "CASE WHEN round(l_discount * 100) < 3 THEN 0 WHEN round(l_discount * 100) <= 7 THEN 1 ELSE 2 END"
)


def spoken_sql(table: str, key: str) -> str:
    text = "text"
    for old, new in SPOKEN_WORDS:
        new = new.replace("'", "''")
        text = f"replace({text}, ' {old} ', ' {new} ')"
    return f"SELECT {key}, {text} AS text FROM {table}"


SQL: dict[str, tuple[list[str], str]] = {
    "catalog": ([], f"""
        SELECT p_partkey AS id, p_name AS title, p_brand AS developer, {_GENRES} AS genres,
               p_retailprice AS price, CAST({FIRST_YEAR} + p_size % 7 AS INTEGER) AS release_date
        FROM part"""),
    "releases": ([], """
        SELECT l_orderkey * 10 + l_linenumber AS id, p_brand AS developer,
               year(l_shipdate) AS release_date, l_tax AS price
        FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "reviews": ([], f"""
        SELECT CAST(o_custkey AS VARCHAR) AS user_id, l_partkey AS item_id,
               {_RECOMMEND} AS recommend, {_SENTIMENT} AS sentiment_analysis
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "plays": ([], """
        SELECT CAST(o_custkey AS VARCHAR) AS user_id, l_partkey AS item_id, p_name AS item_name,
               CAST(l_quantity AS BIGINT) AS playtime_forever, l_orderkey, l_linenumber
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""),
    "interactions": ([], f"""
        SELECT CAST(o_custkey AS VARCHAR) AS user_id, l_partkey AS item_id,
               CAST({_RECOMMEND} AS INTEGER) AS recommend, {_SENTIMENT} AS sentiment_analysis,
               p_name AS item_name, CAST(l_quantity AS BIGINT) AS playtime_forever,
               {_GENRES} AS genres, year(l_shipdate) AS release_date, p_retailprice AS price,
               p_brand AS developer
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""),
    "ratings": (["interactions"], """
        SELECT user_id, item_id, CAST(max(recommend + sentiment_analysis) AS DOUBLE) AS rating
        FROM interactions GROUP BY user_id, item_id"""),
    "catalog_raw": ([], """
        SELECT o_orderkey AS k,
          CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE ' studio ' || o_orderpriority || '  ' END AS publisher,
          '/item/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS url,
          CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 5 THEN ['Free to Play', o_orderpriority]
               ELSE ['Tagged', o_orderpriority] END AS tags,
          CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ['Free to Play', 'Indie']
               ELSE ['Action', o_orderpriority] END AS genres,
          'title ' || o_orderkey AS title,
          CASE o_orderkey % 9 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
               WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 2 THEN 'Jan ' || year(o_orderdate)
               WHEN 3 THEN year(o_orderdate) || ' Q1' WHEN 4 THEN 'Coming Soon' WHEN 5 THEN 'TBA'
               WHEN 6 THEN 'Not out yet ever' WHEN 7 THEN year(o_orderdate) || ' Q2' END AS release_date,
          CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Free' WHEN 2 THEN 'Starting at $499.00'
               WHEN 3 THEN 'Starting at $449.00' WHEN 4 THEN 'Starting at $9.00'
               ELSE printf('%.3f', floor(o_totalprice) + (o_orderkey % 8) * 0.125) END AS price,
          CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey // 2 AS VARCHAR) END AS id,
          CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE lower(o_orderstatus) || '-box games ' END AS developer
        FROM orders"""),
    "lexicon": ([], "SELECT * FROM (VALUES " + ", ".join(
        f"('{w}', CAST({v} AS DOUBLE))" for w, v in LEXICON) + ") AS l(token, valence)"),
    "spoken_documents": ([], spoken_sql("documents", "doc_id")),
    "spoken_conversations": ([], spoken_sql("conversations", "conv_id, turn")),
}
