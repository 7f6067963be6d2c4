"""Scalar functions, nested columns and sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise import functions as fn
from shelfwise.checks.registry import query
from shelfwise.checks.tables import Tables, ctes
from shelfwise.operators import sentiment

# White space as the Unicode standard and Python see it, for regular expressions in SQL.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def words_sql(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_WS}+'), lambda w: w <> '')"


# ----------------------------------------------------------------------------------- text functions


@query("title_case", """
    SELECT doc_id, array_to_string(list_transform(
        regexp_extract_all(text, '([\\p{Lu}\\p{Ll}\\p{Lt}]+|[^\\p{Lu}\\p{Ll}\\p{Lt}]+)', 1),
        lambda w: CASE WHEN w[1] = 'ß' THEN 'Ss' ELSE upper(w[1]) END || lower(substr(w, 2))), '') AS text
    FROM documents""")
def _(t: Tables) -> DataFrame:
    return t.texts("documents").select("doc_id", fn.title_case(F.col("text")).alias("text"))


@query("capitalize", """
    SELECT doc_id, CASE WHEN text[1] = 'ß' THEN 'Ss' ELSE upper(text[1]) END || lower(substr(text, 2)) AS text FROM documents""")
def _(t: Tables) -> DataFrame:
    return t.texts("documents").select("doc_id", fn.capitalize(F.col("text")).alias("text"))


@query("trim_whitespace", f"""
    SELECT doc_id, regexp_replace(padded, '{_WS}+$', '') AS rstripped,
        regexp_replace(padded, '^{_WS}+', '') AS lstripped
    FROM (SELECT doc_id, chr(9) || ' ' || text || ' ' || chr(9) AS padded FROM documents)""")
def _(t: Tables) -> DataFrame:
    padded = F.concat(F.lit("\t "), F.col("text"), F.lit(" \t"))
    return t.texts("documents").select(
        "doc_id", fn.trim_right(padded).alias("rstripped"), fn.trim_left(padded).alias("lstripped")
    )


@query("lower_case", "SELECT doc_id, lower(text) AS text FROM documents")
def _(t: Tables) -> DataFrame:
    return t.texts("documents").select("doc_id", F.lower("text").alias("text"))


@query("replace_literal", r"""
    SELECT event_id, replace(replace(props, '{', ''), '"', '') AS props FROM events""")
def _(t: Tables) -> DataFrame:
    bare = F.replace(F.replace(F.col("props"), F.lit("{"), F.lit("")), F.lit('"'), F.lit(""))
    return t.read("events").select("event_id", bare.alias("props"))


@query("split_part", """
    SELECT o_orderkey, string_split(o_orderpriority, '-')[1] AS head,
        string_split(o_orderpriority, '-')[3] AS third,
        string_split(strftime(o_orderdate, '%d.%m.%Y'), '.')[3] AS year
    FROM orders""")
def _(t: Tables) -> DataFrame:
    priority, date = F.col("o_orderpriority"), F.date_format("o_orderdate", "dd.MM.yyyy")
    return t.read("orders").select(
        "o_orderkey",
        fn.split_part(priority, "-", 0).alias("head"),
        fn.split_part(priority, "-", 2).alias("third"),
        fn.split_part(date, ".", 2).alias("year"),
    )


@query("word_count", f"""
    SELECT doc_id, len({words_sql('text')}) AS n_words FROM documents""")
def _(t: Tables) -> DataFrame:
    return t.texts("documents").select("doc_id", fn.word_count(F.col("text")).alias("n_words"))


YEAR_SQL = """CASE o_orderkey % 9 WHEN 0 THEN year(o_orderdate) WHEN 1 THEN year(o_orderdate)
        WHEN 2 THEN year(o_orderdate) WHEN 3 THEN year(o_orderdate) WHEN 6 THEN 2017 END"""


@query("parse_release_year", f"""
    SELECT '/item/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS url, {YEAR_SQL} AS year
    FROM orders""")
def _(t: Tables) -> DataFrame:
    year = fn.parse_release_year(F.col("release_date"))
    return t.catalog_raw().select("url", year.alias("year"))


PRICE_SQL = """CASE WHEN price IS NULL THEN CASE WHEN list_contains(genres, 'Free to Play')
            OR list_contains(tags, 'Free to Play') THEN 0.0 END
        WHEN price = 'Starting at $499.00' THEN 499.0 WHEN price = 'Starting at $449.00' THEN 449.0
        ELSE coalesce(round(TRY_CAST(price AS DOUBLE), 2), 0.0) END"""


@query("parse_price", ctes("catalog_raw") + f"""
    SELECT url, CAST({PRICE_SQL} AS DOUBLE) AS price FROM catalog_raw""")
def _(t: Tables) -> DataFrame:
    price = fn.parse_price(F.col("price"), F.col("genres"), F.col("tags"))
    return t.catalog_raw().select("url", price.alias("price"))


@query("try_numeric", ctes("catalog_raw") + """
    SELECT url, TRY_CAST(price AS DOUBLE) AS price FROM catalog_raw""")
def _(t: Tables) -> DataFrame:
    return t.catalog_raw().select("url", fn.try_numeric(F.col("price")).alias("price"))


@query("round_2", """
    SELECT l_orderkey, l_linenumber, round(l_extendedprice / 3, 2) AS third FROM lineitem""")
def _(t: Tables) -> DataFrame:
    third = F.round(F.col("l_extendedprice") / 3, 2)
    return t.read("lineitem").select("l_orderkey", "l_linenumber", third.alias("third"))


@query("round_half_even", """
    SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 2, 0) AS INTEGER) AS half FROM lineitem""")
def _(t: Tables) -> DataFrame:
    half = fn.round_half_even(F.col("l_quantity") / 2)
    return t.read("lineitem").select("l_orderkey", "l_linenumber", half.alias("half"))


@query("format_percent", """
    SELECT o_custkey, CASE WHEN f = 0 THEN '0%' ELSE CAST(round(f / n * 100, 2) AS VARCHAR) || '%' END AS filled,
        'Orders: ' || n AS label
    FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f
        FROM orders GROUP BY o_custkey)""")
def _(t: Tables) -> DataFrame:
    grouped = t.read("orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f")
    )
    return grouped.select(
        "o_custkey", fn.percent_text(F.col("f"), F.col("n")).alias("filled"),
        F.concat(F.lit("Orders: "), F.col("n")).alias("label"),
    )


# ----------------------------------------------------------------------------------- nested columns


@query("explode_nested", """
    SELECT doc_id, r.review, r.part FROM (
        SELECT doc_id, unnest(CASE WHEN doc_id % 5 = 0 THEN [NULL]
            WHEN doc_id % 5 = 1 THEN [{'review': source, 'part': 1}]
            ELSE [{'review': source, 'part': 1}, {'review': lang, 'part': 2}] END) AS r
        FROM documents)""")
def _(t: Tables) -> DataFrame:
    first = F.struct(F.col("source").alias("review"), F.lit(1).alias("part"))
    second = F.struct(F.col("lang").alias("review"), F.lit(2).alias("part"))
    k = F.col("doc_id") % 5
    listed = t.texts("documents").select(
        "doc_id",
        F.when(k == 0, F.slice(F.array(first), 1, 0)).when(k == 1, F.array(first))
        .otherwise(F.array(first, second)).alias("reviews"),
    )
    return fn.expand_struct(fn.explode_nested(listed, "reviews", "r"), "r")


@query("expand_struct", ctes("plays") + """
    SELECT user_id, item_id, item_name, playtime_forever, CAST(0 AS BIGINT) AS playtime_2weeks FROM plays""")
def _(t: Tables) -> DataFrame:
    rows = t.libraries().select("user_id", F.explode("items").alias("item"))
    return fn.expand_struct(rows, "item")


@query("distinct_array_elements", ctes("catalog") + """
    SELECT DISTINCT unnest(genres) AS genre FROM catalog""")
def _(t: Tables) -> DataFrame:
    return fn.distinct_array_elements(t.catalog(), "genres", "genre")


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_NAMES = ["anvil", "blue", "bolt", "cold", "gear", "gizmo", "hot", "large", "new", "old", "plate", "red",
          "ring", "rod", "small", "widget"]


@query("one_hot_array", ctes("catalog") + "SELECT id, " + ", ".join(
    f"CAST(list_contains(genres, '{v}') AS INTEGER) AS {prefix}{v}"
    for prefix, values in (("type_", _TYPES), ("name_", _NAMES)) for v in values) + " FROM catalog")
def _(t: Tables) -> DataFrame:
    types = fn.one_hot_array(t.catalog().select("id", "genres"), "genres", _TYPES, "type_")
    return fn.one_hot_array(types, "genres", _NAMES, "name_").drop("genres")


@query("build_year_map", ctes("interactions") + """
    SELECT developer, 'Year ' || release_date AS year, 'Hours: ' || CAST(sum(playtime_forever) AS BIGINT) AS hours
    FROM interactions GROUP BY developer, release_date""")
def _(t: Tables) -> DataFrame:
    per_year = t.interactions().groupBy("developer", F.col("release_date").alias("year")).agg(
        F.sum("playtime_forever").alias("hours")
    )
    maps = per_year.groupBy("developer").agg(
        fn.build_year_map(F.collect_list(F.struct("year", "hours"))).alias("by_year")
    )
    return maps.select("developer", F.explode("by_year").alias("year", "hours"))


@query("parse_nested_ids", ctes("plays") + "SELECT user_id, item_id FROM plays")
def _(t: Tables) -> DataFrame:
    stored = t.libraries_raw().select("user_id", F.to_json("items").alias("items"))
    return stored.select("user_id", F.explode(fn.parse_nested_ids(F.col("items"))).alias("item_id"))


# ---------------------------------------------------------------------------------------- sentiment


def sentiment_sql(table: str, keys: str, text: str = "text") -> str:
    """CTEs ending in ``scored`` (keys, compound): the scoring rules over token rows and windows."""
    up = ", ".join(f"'{w}'" for w in sentiment.INTENSIFIERS)
    down = ", ".join(f"'{w}'" for w in sentiment.DAMPENERS)
    negators = ", ".join("'" + w.replace("'", "''") + "'" for w in sentiment.NEGATORS)
    s = sentiment

    def step(i: int, value: str) -> str:
        damping = s.DISTANCE_DAMPING[i - 1]
        boost = f"""(CASE WHEN x{i} THEN 0 WHEN w{i} IN ({up}) THEN {s.BOOST} + CASE WHEN u{i} AND mixed THEN {s.CAPITALS} ELSE 0 END
            WHEN w{i} IN ({down}) THEN -{s.BOOST} + CASE WHEN u{i} AND mixed THEN {s.CAPITALS} ELSE 0 END ELSE 0 END)"""
        so = " OR ".join(f"coalesce(w{j} IN ('so', 'this'), false)" for j in range(1, i)) or "false"
        never = f"WHEN w{i} = 'never' AND ({so}) THEN {s.NEVER_SO[i - 2]}" if i > 1 else ""
        turn = f"""(CASE {never} WHEN x{i} THEN 1
            WHEN w{i} IN ({negators}) OR contains(w{i}, 'n''t') THEN {s.NEGATION} ELSE 1 END)"""
        return f"({value} + sign({value}) * {boost} * {damping}) * {turn}"

    idioms = [f"WHEN {{p}} = '{phrase}' THEN {valence}" for phrase, valence in s.IDIOMS.items()]
    phrases = ["o || ' ' || p1 || ' ' || p2", "o || ' ' || p1", "o1 || ' ' || o", "o2 || ' ' || o1 || ' ' || o", "o2 || ' ' || o1",
               "o3 || ' ' || o2 || ' ' || o1", "o3 || ' ' || o2"]
    idiom = "CASE " + " ".join(i.format(p=p) for p in phrases for i in idioms) + " END"
    damped = ", ".join(f"'{w}'" for w in s.DAMPENERS if " " in w)

    return f"""
    raw_words AS (SELECT {keys}, {text} AS whole, {words_sql(text)} AS ws FROM {table}),
    cleaned AS (SELECT {keys}, whole, list_filter(list_transform(ws, lambda w:
        CASE WHEN length(regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')) > 1
             THEN regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g') ELSE w END),
        lambda w: length(w) > 1) AS ws FROM raw_words),
    flat AS (SELECT {keys}, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM cleaned),
    marked AS (SELECT {keys}, pos, word AS o, lower(word) AS w, upper(word) = word AND lower(word) <> word AS u,
        valence AS v FROM flat LEFT JOIN lexicon ON token = lower(word)),
    placed AS (SELECT {keys}, min(pos) FILTER (w = 'but') AS but, bool_or(NOT u) AS mixed
        FROM marked GROUP BY {keys}),
    around AS (SELECT *, lag(w, 1) OVER o AS w1, lag(w, 2) OVER o AS w2, lag(w, 3) OVER o AS w3,
        lag(u, 1) OVER o AS u1, lag(u, 2) OVER o AS u2, lag(u, 3) OVER o AS u3, lead(w, 1) OVER o AS n1,
        lag(o, 1) OVER o AS o1, lag(o, 2) OVER o AS o2, lag(o, 3) OVER o AS o3, lead(o, 1) OVER o AS p1, lead(o, 2) OVER o AS p2,
        lag(v, 1) OVER o IS NOT NULL AS x1, lag(v, 2) OVER o IS NOT NULL AS x2,
        lag(v, 3) OVER o IS NOT NULL AS x3
        FROM marked WINDOW o AS (PARTITION BY {keys} ORDER BY pos)),
    v0 AS (SELECT a.*, but, mixed, CASE WHEN u AND mixed THEN v + sign(v) * {s.CAPITALS} ELSE v END AS s0
        FROM around a JOIN placed USING ({keys})
        WHERE v IS NOT NULL AND w NOT IN ({up}, {down}) AND NOT (w = 'kind' AND coalesce(n1, '') = 'of')),
    v1 AS (SELECT *, {step(1, 's0')} AS s1 FROM v0),
    v2 AS (SELECT *, {step(2, 's1')} AS s2 FROM v1),
    v3t AS (SELECT *, {step(3, 's2')} AS t3 FROM v2),
    v3 AS (SELECT *, CASE WHEN o3 IS NULL OR x3 THEN t3 ELSE coalesce({idiom}, t3)
        - CASE WHEN o2 || ' ' || o1 IN ({damped}) OR o3 || ' ' || o2 IN ({damped}) THEN {s.BOOST} ELSE 0 END END AS s3 FROM v3t),
    v4 AS (SELECT {keys}, s3 * CASE WHEN w1 = 'least' AND coalesce(w2, '') NOT IN ('at', 'very') THEN {s.NEGATION} ELSE 1 END
        * CASE WHEN pos < but THEN 0.5 WHEN pos > but THEN 1.5 ELSE 1 END AS part FROM v3),
    totals AS (SELECT {keys}, sum(part) AS total FROM v4 GROUP BY {keys}),
    emphasis AS (SELECT {keys}, whole, length(whole) - length(replace(whole, '!', '')) AS ex,
        length(whole) - length(replace(whole, '?', '')) AS qu FROM cleaned),
    loud AS (SELECT {keys}, coalesce(total, 0) + sign(coalesce(total, 0)) * coalesce(least(ex, 4) * {s.EXCLAMATION}
        + CASE WHEN qu > 3 THEN {s.QUESTION_MAX} WHEN qu > 1 THEN qu * {s.QUESTION} ELSE 0 END, 0) AS l
        FROM emphasis LEFT JOIN totals USING ({keys})),
    scored AS (SELECT {keys}, round(l / sqrt(l * l + {s.ALPHA}), 4) AS compound FROM loud)
    """


CLASS_SQL = "CAST(round_even(compound, 0) AS INTEGER) + 1"


@query("sentiment_class", ctes("spoken_documents", "lexicon") + ","
       + sentiment_sql("spoken_documents", "doc_id") + f"""
    SELECT doc_id, {CLASS_SQL} AS sentiment_analysis FROM scored""")
def _(t: Tables) -> DataFrame:
    return sentiment.sentiment_class(t.spoken("documents", "doc_id"), "text", t.lexicon())


@query("sentiment_compound", ctes("spoken_conversations", "lexicon") + ","
       + sentiment_sql("spoken_conversations", "conv_id, turn") + """
    SELECT conv_id, turn, compound + 0.0 AS compound FROM scored""")
def _(t: Tables) -> DataFrame:
    turns = t.spoken("conversations", "conv_id", "turn")
    scored = sentiment.score_texts(turns, "text", t.lexicon())
    return scored.withColumn("compound", F.col("compound") + 0.0)


