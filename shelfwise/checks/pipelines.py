"""Sources, sinks, cleaning pipelines, views and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise import functions as fn
from shelfwise import schemas, sources
from shelfwise.checks.registry import query
from shelfwise.checks.relational import _FREE_SHARE, _HOURS, _SIZES, box_sql, histogram_sql
from shelfwise.checks.scalar import CLASS_SQL, PRICE_SQL, YEAR_SQL, sentiment_sql
from shelfwise.checks.tables import Tables, ctes
from shelfwise.operators import quality
from shelfwise.plans import etl, reports, views

# ---------------------------------------------------------------------------------- sources, sinks


@query("scan_jsonl_gz", """
    SELECT event_id, user_id, event_type, value FROM events""")
def _(t: Tables) -> DataFrame:
    path = sources.scratch_path(t.spark, "events-json")
    events = t.read("events").select("event_id", "user_id", "event_type", "value")
    sources.write_json_gz(events, path)
    return sources.scan_json_lines(t.spark, path, events.schema)


@query("scan_clean_table", ctes("catalog") + """
    SELECT id, title, developer, array_to_string(list_sort(genres), '|') AS genres, price, release_date
    FROM catalog""")
def _(t: Tables) -> DataFrame:
    path = sources.scratch_path(t.spark, "catalog")
    sources.write_parquet(t.catalog(), path)
    clean = sources.scan_parquet(t.spark, path)
    return clean.withColumn("genres", F.array_join(F.array_sort("genres"), "|"))


@query("scan_csv_gz_filter", ctes("plays") + """
    SELECT user_id, item_id FROM plays WHERE user_id = '7'""")
def _(t: Tables) -> DataFrame:
    path = sources.scratch_path(t.spark, "libraries-csv")
    sources.write_csv_gz(t.libraries(), path)
    mine = sources.scan_csv_gz(t.spark, path, schemas.LIBRARIES_CSV, user_id="7")
    return mine.select("user_id", F.explode(fn.parse_nested_ids(F.col("items"))).alias("item_id"))


@query("scan_parquet", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t: Tables) -> DataFrame:
    customers = sources.scan_parquet(t.spark, f"{t.folder}/customer.parquet")
    return customers.select("c_custkey", "c_name", "c_acctbal")


def _literal_text(text: Column) -> Column:
    """A text as Python writes it: single quotes, or double ones if it holds single quotes only."""
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark, code in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\xa0", "\\xa0")):
        escaped = F.replace(escaped, F.lit(mark), F.lit(code))
    double = text.contains("'") & ~text.contains('"')
    single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(single)


def _literal_lines(t: Tables) -> DataFrame:
    """Review records as Python literals; the texts hold quotes, escapes and the word True."""
    text = F.concat(F.lit("It's ': True, "), F.col("text"), F.lit("\t\\n\xa0None"))
    plain = F.when(F.col("doc_id") % 2 == 0, text).otherwise(F.concat(text, F.lit(' "False"')))
    flag = F.when(F.col("doc_id") % 3 == 0, F.lit("True")).otherwise(F.lit("False"))
    line = F.concat(
        F.lit("{'user_id': '"), F.col("doc_id"), F.lit("', 'user_url': None, 'reviews': [{'funny': '', 'posted': "),
        _literal_text(F.col("source")), F.lit(", 'last_edited': None, 'item_id': '"), F.col("doc_id") * 10,
        F.lit("', 'recommend': "), flag, F.lit(", 'review': "), _literal_text(plain), F.lit("}]}"),
    )
    broken = F.when(F.col("doc_id") % 50 == 7, F.substring(line, 1, 60)).otherwise(line)
    return t.texts("documents").select(broken.alias("value"))


@query("parse_literal_lines", """
    SELECT CAST(doc_id AS VARCHAR) AS user_id, CAST(doc_id * 10 AS VARCHAR) AS item_id, source AS posted,
        doc_id % 3 = 0 AS recommend, 'It''s '': True, ' || text || chr(9) || '\\n' || chr(160) || 'None'
        || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' "False"' END AS review
    FROM documents WHERE doc_id % 50 <> 7""")
def _(t: Tables) -> DataFrame:
    path = sources.scratch_path(t.spark, "literal-lines")
    _literal_lines(t).write.text(path)
    parsed = sources.scan_literal_lines(t.spark, path, schemas.REVIEWS_RAW)
    good = parsed.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return etl.flatten_reviews(good).select("user_id", "item_id", "posted", "recommend", "review")


@query("unreadable_literal_lines", """
    SELECT count(*) AS lines, count(*) FILTER (doc_id % 50 = 7) AS unreadable FROM documents""")
def _(t: Tables) -> DataFrame:
    path = sources.scratch_path(t.spark, "literal-lines")
    _literal_lines(t).write.text(path)
    parsed = sources.scan_literal_lines(t.spark, path, schemas.REVIEWS_RAW)
    # Read once into a table: a scan of the marks alone would not parse the rest.
    whole = parsed.select(F.struct("user_id", "reviews").alias("record"), "_corrupt_record")
    return whole.agg(
        F.count("*").alias("lines"), F.count_if(F.col("_corrupt_record").isNotNull()).alias("unreadable")
    )


@query("sink_json_gz", ctes("reviews") + "SELECT * FROM reviews")
def _(t: Tables) -> DataFrame:
    path = sources.scratch_path(t.spark, "reviews-json")
    sources.write_json_gz(t.reviews(), path)
    return sources.scan_json_lines(t.spark, f"{path}/*.gz", schemas.REVIEWS)


@query("sink_csv_gz", ctes("plays") + """
    SELECT user_id, item_id, item_name, playtime_forever FROM plays""")
def _(t: Tables) -> DataFrame:
    path = sources.scratch_path(t.spark, "libraries-csv")
    sources.write_csv_gz(t.libraries(), path)
    stored = sources.scan_csv_gz(t.spark, f"{path}/*.gz", schemas.LIBRARIES_CSV)
    items = F.from_json("items", schemas.LIBRARIES["items"].dataType).alias("items")
    rows = stored.select("user_id", items).select("user_id", F.inline("items"))
    return rows.select("user_id", "item_id", "item_name", "playtime_forever")


@query("sink_parquet_snappy", ctes("interactions") + """
    SELECT user_id, item_id, playtime_forever, release_date FROM interactions""")
def _(t: Tables) -> DataFrame:
    path = sources.scratch_path(t.spark, "interactions")
    rows = t.interactions().select("user_id", "item_id", "playtime_forever", "release_date")
    sources.write_parquet(rows, path, partition_by=["release_date"])
    return sources.scan_parquet(t.spark, path)


# ---------------------------------------------------------------------------------------- pipelines


@query("etl_catalog", ctes("catalog_raw") + f""",
    first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY url) AS r
        FROM catalog_raw WHERE id IS NOT NULL) WHERE r = 1),
    filled AS (SELECT id, title, k AS o_orderkey, coalesce(genres, tags) AS genres, tags, price,
        regexp_replace(coalesce(developer, publisher), '\\s+$', '') AS developer FROM first),
    typed AS (SELECT CAST(id AS BIGINT) AS id, title, genres, {PRICE_SQL} AS price,
        {YEAR_SQL} AS release_date,
        array_to_string(list_transform(regexp_extract_all(developer, '([A-Za-z]+|[^A-Za-z]+)', 1),
            lambda w: upper(w[1]) || lower(substr(w, 2))), '') AS developer
        FROM filled JOIN orders USING (o_orderkey) WHERE developer IS NOT NULL)
    SELECT id, title, developer, array_to_string(genres, '|') AS genres, CAST(price AS DOUBLE) AS price,
        release_date
    FROM typed WHERE genres IS NOT NULL AND price IS NOT NULL AND release_date IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    clean = etl.clean_catalog(t.catalog_raw(), [F.asc("url")])
    return clean.withColumn("genres", F.array_join("genres", "|"))


def _reviews_raw(t: Tables) -> DataFrame:
    """Review records from texts: some without reviews, some with the same review twice."""
    k = F.col("doc_id")
    review = F.struct(
        F.lit("").alias("funny"), F.lit("Posted").alias("posted"), F.lit(None).cast("string").alias("last_edited"),
        (k % 50).cast("string").alias("item_id"), F.lit("").alias("helpful"),
        (k % 3 != 0).alias("recommend"), F.col("text").alias("review"),
    )
    reviews = F.when(k % 10 == 0, F.slice(F.array(review), 1, 0)).when(
        k % 4 == 1, F.array(review, review)).otherwise(F.array(review))
    return t.spoken("documents", "doc_id").select((k % 100).cast("string").alias("user_id"), reviews.alias("reviews"))


@query("etl_reviews", ctes("spoken_documents", "lexicon") + ","
       + sentiment_sql("spoken_documents", "doc_id") + f""",
    copies AS (SELECT *, unnest(range(CASE WHEN doc_id % 4 = 1 THEN 2 ELSE 1 END)) AS copy FROM scored
        WHERE doc_id % 10 <> 0)
    SELECT CAST(doc_id % 100 AS VARCHAR) AS user_id, doc_id % 50 AS item_id, doc_id % 3 <> 0 AS recommend,
        {CLASS_SQL} AS sentiment_analysis FROM copies""")
def _(t: Tables) -> DataFrame:
    return etl.clean_reviews(_reviews_raw(t), t.lexicon())


@query("etl_libraries", ctes("plays") + """
    SELECT user_id, count(*) OVER (PARTITION BY user_id, l_orderkey, l_linenumber // 8) AS items_count,
        item_id, item_name, playtime_forever, CAST(0 AS BIGINT) AS playtime_2weeks FROM plays""")
def _(t: Tables) -> DataFrame:
    path = sources.scratch_path(t.spark, "libraries")
    sources.write_parquet(etl.slim_libraries(t.libraries_raw()), path)
    return sources.scan_parquet(t.spark, path).select("user_id", "items_count", F.inline("items"))


@query("etl_genre_leaders", ctes("plays", "catalog") + _HOURS + """
    SELECT h.genre, h.user_id, l.hours, 'Year ' || h.year AS year, 'Hours: ' || h.hours AS played
    FROM hours h JOIN leaders l USING (genre, user_id)""")
def _(t: Tables) -> DataFrame:
    path = sources.scratch_path(t.spark, "genre-leaders")
    leaders = etl.genre_leaders(etl.genre_hours(t.libraries(), t.catalog()))
    sources.write_parquet(leaders.withColumn("by_year", fn.build_year_map(F.col("by_year"))), path)
    stored = sources.scan_parquet(t.spark, path)
    return stored.select("genre", "user_id", "hours", F.explode("by_year").alias("year", "played"))


@query("build_interactions", ctes("reviews", "plays", "catalog") + _SIZES + """
    SELECT user_id, item_id, CAST(recommend AS INTEGER) AS recommend, sentiment_analysis, items_count, item_name,
        playtime_forever, array_to_string(list_sort(genres), '|') AS genres, release_date, price, developer
    FROM (SELECT DISTINCT * FROM reviews) JOIN sizes USING (user_id)
    JOIN (SELECT DISTINCT user_id, item_id, item_name, playtime_forever FROM plays) USING (user_id, item_id)
    JOIN catalog ON item_id = id""")
def _(t: Tables) -> DataFrame:
    wide = etl.build_interactions(t.reviews(), t.libraries(), t.catalog())
    return wide.withColumn("genres", F.array_join(F.array_sort("genres"), "|"))


# -------------------------------------------------------------------------------------------- views


@query("developer_by_year", ctes("releases") + f"""
    SELECT developer, release_date, {_FREE_SHARE} FROM releases GROUP BY developer, release_date""")
def _(t: Tables) -> DataFrame:
    return views.developer_by_year(t.releases())


@query("developer_by_year_one", ctes("releases") + f"""
    SELECT release_date, {_FREE_SHARE} FROM releases WHERE contains(developer, 'Brand#1') GROUP BY release_date""")
def _(t: Tables) -> DataFrame:
    return views.developer_years(t.releases(), "brand#1")


_SUMMARY = _SIZES + """, spends AS (
        SELECT user_id, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS spent
        FROM (SELECT DISTINCT user_id, item_id FROM plays) JOIN catalog ON item_id = id GROUP BY user_id),
    shares AS (SELECT user_id, round(count(*) FILTER (recommend) / count(*) * 100, 2) AS recommend_percent
        FROM reviews GROUP BY user_id)
    SELECT user_id, spent, recommend_percent, items_count FROM sizes JOIN spends USING (user_id)
    LEFT JOIN shares USING (user_id)"""


@query("user_summary", ctes("plays", "catalog", "reviews") + _SUMMARY)
def _(t: Tables) -> DataFrame:
    return views.user_summaries(t.libraries(), t.catalog(), t.reviews())


@query("user_summary_one", ctes("plays", "catalog", "reviews") + _SUMMARY.replace(
    "SELECT user_id, spent, recommend_percent, items_count FROM sizes", """
    SELECT user_id, spent, recommend_percent, items_count, CAST(spent AS VARCHAR) || ' USD' AS spent_text,
        CAST(recommend_percent AS VARCHAR) || '%' AS recommend_text FROM sizes""") + " WHERE user_id = '42'")
def _(t: Tables) -> DataFrame:
    return views.user_summary(t.libraries(), t.catalog(), t.reviews(), "42")


@query("genre_leader", ctes("plays", "catalog") + _HOURS + """
    SELECT h.genre, h.user_id, h.year, h.hours FROM hours h JOIN leaders USING (genre, user_id)
    WHERE genre = 'Blue'""")
def _(t: Tables) -> DataFrame:
    return views.genre_leader(t.libraries(), t.catalog(), "bLUE")


_VOTES = """, votes AS (SELECT release_date, developer, count(*) FILTER (recommend) AS recommended,
        count(*) FILTER (sentiment_analysis = 2) AS positive, count(*) FILTER (sentiment_analysis = 0) AS negative
        FROM reviews JOIN catalog ON item_id = id GROUP BY release_date, developer)
"""


@query("best_developers_of_year", ctes("reviews", "catalog") + _VOTES + """
    SELECT row_number() OVER (ORDER BY recommended + positive DESC, developer) AS place, developer,
        recommended + positive AS score FROM votes WHERE release_date = 1998
    ORDER BY score DESC, developer LIMIT 3""")
def _(t: Tables) -> DataFrame:
    return views.best_developers_of_year(t.catalog(), t.reviews(), 1998)


@query("best_developers_by_year", ctes("reviews", "catalog") + _VOTES + """
    SELECT release_date, developer, recommended + positive AS score FROM votes
    QUALIFY row_number() OVER (PARTITION BY release_date ORDER BY recommended + positive DESC, developer) <= 3""")
def _(t: Tables) -> DataFrame:
    return views.best_developers_by_year(t.catalog(), t.reviews())


@query("developer_sentiment", ctes("reviews", "catalog") + _VOTES + """
    SELECT developer, CAST(sum(negative) AS BIGINT) AS negative, CAST(sum(positive) AS BIGINT) AS positive
    FROM votes GROUP BY developer""")
def _(t: Tables) -> DataFrame:
    return views.developer_sentiments(t.catalog(), t.reviews())


@query("developer_sentiment_unreviewed", ctes("reviews", "catalog") + """
    SELECT developer, count(*) FILTER (sentiment_analysis = 0) AS negative,
        count(*) FILTER (sentiment_analysis = 2) AS positive
    FROM catalog LEFT JOIN reviews ON item_id = id AND NOT starts_with(developer, 'Brand#1') GROUP BY developer""")
def _(t: Tables) -> DataFrame:
    without = t.catalog().filter(F.col("developer").startswith("Brand#1")).select(F.col("id").alias("item_id"))
    return views.developer_sentiments(t.catalog(), t.reviews().join(without, "item_id", "left_anti"))


@query("developer_sentiment_one", ctes("reviews", "catalog") + _VOTES + """
    , one AS (SELECT CAST(sum(negative) AS BIGINT) AS negative, CAST(sum(positive) AS BIGINT) AS positive
        FROM votes WHERE contains(developer, 'Brand#2'))
    SELECT 'Brand#2' AS developer, negative, positive, 'Negative = ' || negative AS negative_text,
        'Positive = ' || positive AS positive_text FROM one""")
def _(t: Tables) -> DataFrame:
    return views.developer_sentiment(t.catalog(), t.reviews(), "BRAND#2")


# ------------------------------------------------------------------------------------------ reports


def _top_sql(measure: str) -> str:
    return ctes("interactions") + f"""
    SELECT item_name, CAST(sum({measure}) AS BIGINT) AS {measure} FROM interactions GROUP BY item_name
    ORDER BY {measure} DESC, item_name LIMIT 5"""


@query("report_top_playtime", _top_sql("playtime_forever"))
def _(t: Tables) -> DataFrame:
    return reports.top_playtime(t.interactions())


_PRICES = """WITH interactions AS (SELECT p_retailprice AS price FROM lineitem JOIN part ON l_partkey = p_partkey),
"""


@query("report_price_distribution", _PRICES + histogram_sql("interactions", "price") + ","
       + box_sql("interactions", "price") + """
    SELECT 'bin' AS part, lpad(CAST(bin AS VARCHAR), 3, '0') AS name, CAST(n AS DOUBLE) AS value FROM bars
    UNION ALL SELECT 'box', u.name, round(u.value, 4) FROM (UNPIVOT (SELECT CAST(n AS DOUBLE) AS n, q1, median, q3,
        whisker_low, whisker_high, CAST(outliers AS DOUBLE) AS outliers FROM box) ON *
        INTO NAME name VALUE value) u""")
def _(t: Tables) -> DataFrame:
    return reports.price_distribution(t.interactions()).withColumn("value", F.round("value", 4))


_GENRES = ctes("interactions") + """
    SELECT genre, count(*) AS n FROM (SELECT unnest(genres) AS genre FROM interactions) GROUP BY genre"""


@query("report_genre_counts", _GENRES)
def _(t: Tables) -> DataFrame:
    return reports.genre_counts(t.interactions())


@query("report_genre_counts_items", ctes("catalog") + """
    SELECT genre, count(*) AS n FROM (SELECT unnest(genres) AS genre FROM catalog
        WHERE id IN (SELECT l_partkey FROM lineitem)) GROUP BY genre""")
def _(t: Tables) -> DataFrame:
    return reports.genre_counts(t.interactions(), grain="item")


@query("report_top_genres", _GENRES + " ORDER BY n DESC, genre LIMIT 5")
def _(t: Tables) -> DataFrame:
    return reports.top_genres(t.interactions())


@query("report_by_year", ctes("interactions") + """
    SELECT release_date, count(*) AS n FROM interactions GROUP BY release_date ORDER BY release_date""")
def _(t: Tables) -> DataFrame:
    return reports.counts_by_year(t.interactions())


@query("report_recommend_counts", ctes("interactions") + """
    SELECT recommend, count(*) AS n FROM interactions GROUP BY recommend""")
def _(t: Tables) -> DataFrame:
    return reports.recommend_counts(t.interactions())


@query("report_top_recommended", _top_sql("recommend"))
def _(t: Tables) -> DataFrame:
    return reports.top_recommended(t.interactions())


@query("report_sentiment_counts", ctes("interactions") + """
    SELECT sentiment_analysis, count(*) AS n FROM interactions GROUP BY sentiment_analysis""")
def _(t: Tables) -> DataFrame:
    return reports.sentiment_counts(t.interactions())


@query("report_top_sentiment", _top_sql("sentiment_analysis"))
def _(t: Tables) -> DataFrame:
    return reports.top_sentiment(t.interactions())


_RAW = ["id", "genres", "tags", "price", "release_date", "developer", "publisher"]
_DISTINCT = ["price", "release_date", "developer"]
_USUAL = {"price": r"^\d+(\.\d+)?$", "release_date": r"^\d{4}-\d{2}-\d{2}$"}


@query("report_data_quality", ctes("catalog_raw") + " UNION ALL ".join(
    [f"SELECT 'missing' AS \"check\", '{c}' AS subject, count(*) - count({c}) AS value FROM catalog_raw" for c in _RAW]
    + [f"SELECT 'distinct', '{c}', count(DISTINCT {c}) FROM catalog_raw" for c in _DISTINCT]
    + ["""SELECT 'key', CASE WHEN n > 1 THEN 'repeated' ELSE 'single' END, count(*) FROM (SELECT count(*) AS n
        FROM catalog_raw WHERE id IS NOT NULL GROUP BY id) GROUP BY 2"""]
    + [f"SELECT 'unusual', '{c}', count(*) FILTER (NOT regexp_matches({c}, '{p}')) FROM catalog_raw"
       for c, p in _USUAL.items()]))
def _(t: Tables) -> DataFrame:
    return reports.data_quality(t.catalog_raw().select(*_RAW), "id", _DISTINCT, _USUAL)


_FREQUENT = ["id", "genres", "tags", "price", "release_date", "developer", "publisher"]


@query("report_value_frequencies", ctes("catalog_raw") + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {f'CAST(to_json({c}) AS VARCHAR)' if c in ('genres', 'tags') else f'CAST({c} AS VARCHAR)'} AS value, count(*) AS n
    FROM catalog_raw GROUP BY {c}""" for c in _FREQUENT))
def _(t: Tables) -> DataFrame:
    return quality.value_frequencies(t.catalog_raw(), _FREQUENT)


@query("report_dropped_rows", ctes("catalog_raw") + f""",
    ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY url) AS r FROM catalog_raw),
    typed AS (SELECT id, price, coalesce(genres, tags) AS genres, k AS o_orderkey, tags, r, coalesce(developer, publisher) AS developer FROM ranked),
    judged AS (SELECT CASE WHEN id IS NULL THEN 'no id' WHEN r > 1 THEN 'repeated id' WHEN genres IS NULL THEN 'no genres'
            WHEN {PRICE_SQL} IS NULL THEN 'no price' WHEN {YEAR_SQL} IS NULL THEN 'no release_date'
            WHEN developer IS NULL THEN 'no developer' ELSE 'kept' END AS reason
        FROM typed JOIN orders USING (o_orderkey))
    SELECT reason, count(*) AS n FROM judged GROUP BY reason""")
def _(t: Tables) -> DataFrame:
    return reports.dropped_rows(t.catalog_raw(), ["url"])
