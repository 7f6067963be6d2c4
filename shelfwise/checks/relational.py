"""Projections, filters, joins, aggregations, ranking and dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.checks.registry import query
from shelfwise.checks.tables import Tables, ctes
from shelfwise.operators import aggregates, joins, quality, ranking
from shelfwise.plans import etl

# ------------------------------------------------------------------- projections, filters, updates


@query("project_columns", "SELECT p_partkey AS id, p_brand AS developer, p_retailprice AS price FROM part")
def _(t: Tables) -> DataFrame:
    return t.catalog().select("id", "developer", "price")


@query("drop_columns", """
    SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders""")
def _(t: Tables) -> DataFrame:
    return t.read("orders").drop("o_orderdate", "o_orderstatus")


@query("filter_eq", """
    SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
    WHERE l_returnflag = 'R' AND l_tax = 0.0""")
def _(t: Tables) -> DataFrame:
    lines = t.read("lineitem").filter(F.col("l_returnflag") == "R").filter(F.col("l_tax") == 0.0)
    return lines.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("filter_conjunction", """
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE l_returnflag = 'A' AND (l_discount >= 0.05 AND year(l_shipdate) = 1998)""")
def _(t: Tables) -> DataFrame:
    mask = (F.col("l_discount") >= 0.05) & (F.year("l_shipdate") == 1998)
    lines = t.read("lineitem").filter((F.col("l_returnflag") == "A") & mask)
    return lines.select("l_orderkey", "l_linenumber", "l_quantity")


@query("filter_contains", """
    SELECT p_partkey AS id, p_brand AS developer FROM part WHERE contains(p_brand, 'Brand#1')""")
def _(t: Tables) -> DataFrame:
    return t.catalog().filter(F.col("developer").contains("Brand#1")).select("id", "developer")


@query("filter_array_contains", """
    SELECT p_partkey AS id, p_name AS title FROM part
    WHERE list_contains(string_split(p_name, ' '), 'blue') OR p_type = 'blue'""")
def _(t: Tables) -> DataFrame:
    return t.catalog().filter(F.array_contains("genres", "blue")).select("id", "title")


@query("lookup_exists", """
    SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
        AND o_totalprice > 400000) AS known FROM customer""")
def _(t: Tables) -> DataFrame:
    big = t.read("orders").filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000))
    held = big.select(F.col("o_custkey").alias("c_custkey"))
    return joins.lookup_exists(t.read("customer"), held, "c_custkey")


@query("dropna_subset", """
    SELECT url, price, release_date FROM raw
    WHERE price IS NOT NULL AND release_date IS NOT NULL""".replace(
    "SELECT url", ctes("catalog_raw") + "SELECT url").replace("FROM raw", "FROM catalog_raw"))
def _(t: Tables) -> DataFrame:
    raw = t.catalog_raw().dropna(subset=["price", "release_date"])
    return raw.select("url", "price", "release_date")


@query("dropna_all", ctes("catalog_raw") + """
    SELECT url, id, price, release_date FROM catalog_raw
    WHERE id IS NOT NULL OR price IS NOT NULL OR release_date IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    raw = t.catalog_raw().dropna(how="all", subset=["id", "price", "release_date"])
    return raw.select("url", "id", "price", "release_date")


@query("drop_empty_columns", "SELECT event_id, user_id, event_type FROM events")
def _(t: Tables) -> DataFrame:
    events = t.read("events").select(
        "event_id", "user_id", F.lit(None).cast("string").alias("funny"), "event_type",
        F.when(F.col("event_id") < 0, F.col("value")).alias("last_edited"),
    )
    return quality.drop_empty_columns(events)


@query("conditional_update", """
    SELECT l_orderkey, l_linenumber,
        CASE WHEN l_returnflag = 'R' AND l_tax = 0 THEN 0.0 ELSE l_extendedprice END AS l_extendedprice
    FROM lineitem""")
def _(t: Tables) -> DataFrame:
    returned = (F.col("l_returnflag") == "R") & (F.col("l_tax") == 0)
    return t.read("lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(returned, 0.0).otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
    )


@query("fill_from_column", ctes("catalog_raw") + """
    SELECT url, array_to_string(coalesce(genres, tags), '|') AS genres,
        coalesce(developer, publisher) AS developer FROM catalog_raw""")
def _(t: Tables) -> DataFrame:
    return t.catalog_raw().select(
        "url",
        F.array_join(F.coalesce("genres", "tags"), "|").alias("genres"),
        F.coalesce("developer", "publisher").alias("developer"),
    )


@query("fill_constant", """
    SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END, 0.0) AS value
    FROM events""")
def _(t: Tables) -> DataFrame:
    holes = F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value")
    return t.read("events").select("event_id", holes).fillna(0.0, subset=["value"])


@query("recode_values", ctes("reviews") + """
    SELECT user_id, item_id, CAST(sentiment_analysis = 2 AS INTEGER) AS positive FROM reviews""")
def _(t: Tables) -> DataFrame:
    positive = (F.col("sentiment_analysis") == 2).cast("int").alias("positive")
    return t.reviews().select("user_id", "item_id", positive)


@query("cast_columns", ctes("catalog_raw", "reviews") + """
    , numbered AS (SELECT url, TRY_CAST(id AS BIGINT) AS id, TRY_CAST(price AS DOUBLE) AS price
        FROM catalog_raw)
    SELECT url, id, price, CAST(trunc(price) AS INTEGER) AS whole, CAST(id % 2 = 0 AS INTEGER) AS even
    FROM numbered""")
def _(t: Tables) -> DataFrame:
    numbered = t.catalog_raw().select(
        "url", F.col("id").try_cast("bigint").alias("id"), F.col("price").try_cast("double").alias("price")
    )
    return numbered.select(
        "*", F.col("price").cast("int").alias("whole"), (F.col("id") % 2 == 0).cast("int").alias("even")
    )


@query("add_constant_columns", """
    SELECT o_orderkey, 0 AS hours, CAST(NULL AS VARCHAR) AS leader FROM orders""")
def _(t: Tables) -> DataFrame:
    return t.read("orders").select(
        "o_orderkey", F.lit(0).alias("hours"), F.lit(None).cast("string").alias("leader")
    )


# ------------------------------------------------------------------------------------------- joins


@query("join_reviews_catalog", ctes("reviews", "catalog") + """
    SELECT user_id, item_id, recommend, developer, release_date
    FROM reviews JOIN catalog ON item_id = id""")
def _(t: Tables) -> DataFrame:
    rows = t.reviews().select("user_id", "item_id", "recommend")
    return joins.join_catalog(rows, t.catalog(), ["developer", "release_date"])


@query("join_items_catalog", ctes("plays", "catalog") + """
    SELECT user_id, item_id, playtime_forever, array_to_string(list_sort(genres), '|') AS genres, release_date
    FROM plays JOIN catalog ON item_id = id""")
def _(t: Tables) -> DataFrame:
    items = joins.library_items(t.libraries()).select("user_id", "item_id", "playtime_forever")
    joined = joins.join_catalog(items, t.catalog(), ["genres", "release_date"])
    return joined.withColumn("genres", F.array_join(F.array_sort("genres"), "|"))


@query("join_owned_prices", ctes("plays", "catalog") + """
    SELECT DISTINCT user_id, item_id, price FROM plays JOIN catalog ON item_id = id""")
def _(t: Tables) -> DataFrame:
    owned = joins.library_items(t.libraries()).select("user_id", "item_id").distinct()
    return joins.join_catalog(owned, t.catalog(), ["price"])


_SIZES = ", sizes AS (SELECT user_id, count(*) AS items_count FROM plays GROUP BY user_id)\n"


@query("join_left_dedup", ctes("reviews", "plays") + _SIZES + """
    SELECT DISTINCT user_id, item_id, recommend, sentiment_analysis, items_count
    FROM reviews LEFT JOIN (SELECT * FROM sizes WHERE items_count > 20) USING (user_id)""")
def _(t: Tables) -> DataFrame:
    sizes = etl.library_sizes(t.libraries()).filter(F.col("items_count") > 20)
    return joins.join_left_dedup(t.reviews(), sizes, "user_id")


@query("join_composite_key", ctes("reviews", "plays") + """
    SELECT user_id, item_id, recommend, playtime_forever
    FROM (SELECT DISTINCT user_id, item_id, recommend FROM reviews)
    JOIN (SELECT DISTINCT user_id, item_id, playtime_forever FROM plays) USING (user_id, item_id)""")
def _(t: Tables) -> DataFrame:
    reviews = t.reviews().select("user_id", "item_id", "recommend").distinct()
    items = joins.library_items(t.libraries()).select("user_id", "item_id", "playtime_forever").distinct()
    return reviews.join(items, ["user_id", "item_id"])


@query("anti_join_owned", ctes("plays") + """
    SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS user_id, l_suppkey AS item_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE NOT EXISTS (SELECT 1 FROM plays
        WHERE user_id = CAST(o_custkey AS VARCHAR) AND item_id = l_suppkey)""")
def _(t: Tables) -> DataFrame:
    candidates = t.user_lines().select("user_id", F.col("l_suppkey").alias("item_id")).distinct()
    return joins.anti_join_owned(candidates, t.plays(), ["user_id", "item_id"])


# ------------------------------------------------------------------------------------ aggregations


@query("count_by_year", ctes("releases") + """
    SELECT release_date, count(*) AS items FROM releases GROUP BY release_date""")
def _(t: Tables) -> DataFrame:
    return t.releases().groupBy("release_date").agg(F.count("*").alias("items"))


_FREE_SHARE = """count(*) AS items, count(*) FILTER (price = 0) AS free_items,
        round(count(*) FILTER (price = 0) / count(*) * 100, 2) AS free_percent,
        CASE WHEN count(*) FILTER (price = 0) = 0 THEN '0%'
             ELSE CAST(round(count(*) FILTER (price = 0) / count(*) * 100, 2) AS VARCHAR) || '%' END AS free_text"""


@query("free_share_by_year", ctes("releases") + f"""
    SELECT release_date, {_FREE_SHARE} FROM releases GROUP BY release_date""")
def _(t: Tables) -> DataFrame:
    return aggregates.free_share(t.releases(), "release_date")


@query("sum_total", """
    SELECT round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS total FROM lineitem""")
def _(t: Tables) -> DataFrame:
    return t.read("lineitem").agg(F.round(aggregates.money_sum("l_extendedprice"), 2).alias("total"))


@query("recommend_share", ctes("reviews") + """
    SELECT user_id, count(*) AS reviews, count(*) FILTER (recommend) AS recommended,
        round(count(*) FILTER (recommend) / count(*) * 100, 2) AS recommend_percent
    FROM reviews GROUP BY user_id""")
def _(t: Tables) -> DataFrame:
    return aggregates.recommend_share(t.reviews(), "user_id")


@query("sum_by_group", ctes("interactions") + """
    SELECT developer, CAST(sum(recommend) AS BIGINT) AS recommend, CAST(sum(sentiment_analysis) AS BIGINT) AS sentiment_analysis
    FROM interactions GROUP BY developer""")
def _(t: Tables) -> DataFrame:
    return aggregates.sum_by_group(t.interactions(), ["developer"], ["recommend", "sentiment_analysis"])


@query("value_counts", ctes("reviews") + """
    SELECT sentiment_analysis, count(*) AS n FROM reviews GROUP BY sentiment_analysis""")
def _(t: Tables) -> DataFrame:
    return aggregates.value_counts(t.reviews(), "sentiment_analysis")


@query("duplicate_key_report", ctes("catalog_raw") + """
    SELECT n > 1 AS repeated, count(*) AS keys
    FROM (SELECT id, count(*) AS n FROM catalog_raw WHERE id IS NOT NULL GROUP BY id) GROUP BY n > 1""")
def _(t: Tables) -> DataFrame:
    return quality.duplicate_key_report(t.catalog_raw(), "id")


@query("distinct_values", ctes("catalog_raw") + "SELECT DISTINCT price FROM catalog_raw")
def _(t: Tables) -> DataFrame:
    return t.catalog_raw().select("price").distinct()


_RAW_COLUMNS = ["publisher", "url", "tags", "genres", "title", "release_date", "price", "id", "developer"]


@query("null_counts", ctes("catalog_raw") + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM catalog_raw" for c in _RAW_COLUMNS))
def _(t: Tables) -> DataFrame:
    return quality.null_counts(t.catalog_raw().select(*_RAW_COLUMNS))


@query("column_profile", ctes("catalog_raw") + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{'array<string>' if c in ('tags', 'genres') else 'string'}' AS type, "
    f"count({c}) AS non_null FROM catalog_raw" for c in _RAW_COLUMNS))
def _(t: Tables) -> DataFrame:
    return quality.column_profile(t.catalog_raw().select(*_RAW_COLUMNS))


_HOURS = """, played AS (
        SELECT user_id, release_date AS year, playtime_forever, unnest(list_distinct(list_transform(
            genres, lambda g: upper(g[1]) || lower(substr(g, 2))))) AS genre
        FROM plays JOIN catalog ON item_id = id),
    hours AS (SELECT genre, user_id, year, CAST(sum(playtime_forever) AS BIGINT) AS hours
        FROM played GROUP BY genre, user_id, year),
    per_user AS (SELECT genre, user_id, CAST(sum(hours) AS BIGINT) AS hours FROM hours GROUP BY genre, user_id),
    leaders AS (SELECT genre, user_id, hours FROM (SELECT *, row_number() OVER (
        PARTITION BY genre ORDER BY hours DESC, user_id) AS r FROM per_user) WHERE r = 1)
"""


@query("hours_by_genre_user", ctes("plays", "catalog") + _HOURS + "SELECT genre, user_id, hours FROM per_user")
def _(t: Tables) -> DataFrame:
    hours = etl.genre_hours(t.libraries(), t.catalog())
    return hours.groupBy("genre", "user_id").agg(F.sum("hours").alias("hours"))


@query("leader_hours_by_year", ctes("plays", "catalog") + _HOURS + """
    SELECT h.genre, h.user_id, h.year, h.hours FROM hours h JOIN leaders USING (genre, user_id)""")
def _(t: Tables) -> DataFrame:
    return etl.leader_rows(etl.genre_leaders(etl.genre_hours(t.libraries(), t.catalog())))


@query("playtime_by_item", ctes("interactions") + """
    SELECT item_name, CAST(sum(playtime_forever) AS BIGINT) AS playtime_forever FROM interactions GROUP BY item_name""")
def _(t: Tables) -> DataFrame:
    return aggregates.sum_by_group(t.interactions(), ["item_name"], ["playtime_forever"])


@query("count_by_genre", ctes("interactions") + """
    SELECT genre, count(*) AS n FROM (SELECT unnest(genres) AS genre FROM interactions) GROUP BY genre""")
def _(t: Tables) -> DataFrame:
    return aggregates.count_by_element(t.interactions(), "genres", "genre")


@query("recommend_by_item", ctes("interactions") + """
    SELECT item_name, CAST(sum(recommend) AS BIGINT) AS recommend FROM interactions GROUP BY item_name""")
def _(t: Tables) -> DataFrame:
    return aggregates.sum_by_group(t.interactions(), ["item_name"], ["recommend"])


@query("sentiment_by_item", ctes("interactions") + """
    SELECT item_name, CAST(sum(sentiment_analysis) AS BIGINT) AS sentiment_analysis
    FROM interactions GROUP BY item_name""")
def _(t: Tables) -> DataFrame:
    return aggregates.sum_by_group(t.interactions(), ["item_name"], ["sentiment_analysis"])


def histogram_sql(table: str, column: str, bins: int = 30) -> str:
    """(bin, lower, upper, n) in SQL."""
    return f"""bounds AS (SELECT CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi FROM {table}),
    counted AS (SELECT least(CAST(floor(({column} - lo) / (hi - lo) * {bins}) AS BIGINT) + 1, {bins}) AS bin, count(*) AS n
        FROM {table}, bounds GROUP BY 1),
    bars AS (SELECT i AS bin, lo + (i - 1) * ((hi - lo) / {bins}) AS lower, lo + i * ((hi - lo) / {bins}) AS upper,
        coalesce(n, 0) AS n FROM range(1, {bins + 1}) r(i) CROSS JOIN bounds LEFT JOIN counted ON bin = i)
    """


def box_sql(table: str, column: str) -> str:
    return f"""quartiles AS (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.5) AS median,
        quantile_cont({column}, 0.75) AS q3 FROM {table}),
    box AS (SELECT count(*) AS n, max(q1) AS q1, max(median) AS median, max(q3) AS q3,
        min({column}) FILTER ({column} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
        max({column}) FILTER ({column} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
        count(*) FILTER (NOT {column} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
        FROM {table}, quartiles)
    """


@query("price_histogram", "WITH " + histogram_sql("lineitem", "l_extendedprice") + """
    SELECT bin, round(lower, 4) AS lower, round(upper, 4) AS upper, n FROM bars""")
def _(t: Tables) -> DataFrame:
    bars = aggregates.histogram(t.read("lineitem"), "l_extendedprice")
    return bars.select("bin", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"), "n")


@query("price_box_stats", "WITH " + box_sql("orders", "o_totalprice") + """
    SELECT n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
        whisker_low, whisker_high, outliers FROM box""")
def _(t: Tables) -> DataFrame:
    box = aggregates.box_stats(t.read("orders"), "o_totalprice")
    return box.select(
        "n", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")],
        "whisker_low", "whisker_high", "outliers",
    )


@query("first_value_per_key", """
    SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey""")
def _(t: Tables) -> DataFrame:
    return aggregates.first_value_per_key(t.read("orders"), "o_custkey", "o_totalprice", "o_orderkey")


@query("row_sum", ctes("interactions") + """
    SELECT user_id, item_id, playtime_forever + recommend + sentiment_analysis AS total
    FROM interactions""")
def _(t: Tables) -> DataFrame:
    total = aggregates.row_sum("playtime_forever", "recommend", "sentiment_analysis")
    return t.interactions().select("user_id", "item_id", total.alias("total"))


# ------------------------------------------------------------------------------ ranking and dedup


@query("top_user_per_genre", ctes("plays", "catalog") + _HOURS + "SELECT genre, user_id, hours FROM leaders")
def _(t: Tables) -> DataFrame:
    hours = etl.genre_hours(t.libraries(), t.catalog())
    per_user = hours.groupBy("genre", "user_id").agg(F.sum("hours").alias("hours"))
    return ranking.top_per_group(per_user, ["genre"], [F.desc("hours"), F.asc("user_id")])


@query("rank_top3", ctes("interactions") + """
    SELECT row_number() OVER (ORDER BY n DESC, developer) AS place, developer, n
    FROM (SELECT developer, count(*) AS n FROM interactions GROUP BY developer)
    ORDER BY n DESC, developer LIMIT 3""")
def _(t: Tables) -> DataFrame:
    return ranking.rank_top(aggregates.value_counts(t.interactions(), "developer"), "n", "developer", 3)


@query("sort_by_key", ctes("releases") + """
    SELECT release_date, count(*) AS n FROM releases GROUP BY release_date ORDER BY release_date""")
def _(t: Tables) -> DataFrame:
    return aggregates.value_counts(t.releases(), "release_date").orderBy("release_date")


@query("top_k", """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5""")
def _(t: Tables) -> DataFrame:
    return ranking.top_k(t.read("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 5)


@query("sample_matching", ctes("catalog_raw") + """
    SELECT url, price, array_to_string(genres, '|') AS genres FROM catalog_raw
    WHERE list_bool_or(list_transform(genres, lambda g: contains(g, 'Free')))
    ORDER BY url LIMIT 15""")
def _(t: Tables) -> DataFrame:
    rows = ranking.sample_matching(t.catalog_raw(), "genres", "Free", "url", ["price", "genres"], 15)
    return rows.withColumn("genres", F.array_join("genres", "|"))


@query("dedup_keep_first", ctes("catalog_raw") + """
    SELECT id, url, price, release_date FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY url) AS r
        FROM catalog_raw WHERE id IS NOT NULL) WHERE r = 1""")
def _(t: Tables) -> DataFrame:
    raw = t.catalog_raw().dropna(subset=["id"]).select("id", "url", "price", "release_date")
    return ranking.dedup_keep_first(raw, "id", [F.asc("url")])


@query("dedup_rows", ctes("reviews") + """
    SELECT DISTINCT user_id, item_id, recommend, sentiment_analysis FROM reviews""")
def _(t: Tables) -> DataFrame:
    return t.reviews().distinct()
