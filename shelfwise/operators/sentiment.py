"""Sentiment class of texts by a valence lexicon (Hutto & Gilbert, ICWSM 2014).

A text is cut into tokens, each token keeps the words around it and is looked up in the lexicon
by a join; the valences of a text are then summed. The context travels with the token, so the only
shuffle carries one partial sum per text instead of its tokens.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.text import SPACE, round_half_even

# The published word lists and constants of the rule set.
NEGATORS = [
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "ain't", "aren't",
    "can't", "couldn't", "daren't", "didn't", "doesn't", "dont", "hadnt", "hasnt", "havent",
    "isnt", "mightnt", "mustnt", "neither", "don't", "hadn't", "hasn't", "haven't", "isn't",
    "mightn't", "mustn't", "neednt", "needn't", "never", "none", "nope", "nor", "not", "nothing",
    "nowhere", "oughtnt", "shant", "shouldnt", "uhuh", "wasnt", "werent", "oughtn't", "shan't",
    "shouldn't", "uh-uh", "wasn't", "weren't", "without", "wont", "wouldnt", "won't", "wouldn't",
    "rarely", "seldom", "despite",
]
INTENSIFIERS = [
    "absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly", "deeply",
    "effing", "enormously", "entirely", "especially", "exceptionally", "extremely", "fabulously",
    "flipping", "flippin", "fricking", "frickin", "frigging", "friggin", "fully", "fucking",
    "greatly", "hella", "highly", "hugely", "incredibly", "intensely", "majorly", "more", "most",
    "particularly", "purely", "quite", "really", "remarkably", "so", "substantially",
    "thoroughly", "totally", "tremendously", "uber", "unbelievably", "unusually", "utterly",
    "very",
]
DAMPENERS = [
    "almost", "barely", "hardly", "just enough", "kind of", "kinda", "kindof", "kind-of", "less",
    "little", "marginally", "occasionally", "partly", "scarcely", "slightly", "somewhat",
    "sort of", "sorta", "sortof", "sort-of",
]
# Phrases whose valence stands for that of the words around them, in the order of the rule.
IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "yeah right": -2.0, "cut the mustard": 2.0, "kiss of death": -1.5,
    "hand to mouth": -2.0,
}
BOOST = 0.293
CAPITALS = 0.733
NEGATION = -0.74
DISTANCE_DAMPING = (1.0, 0.95, 0.9)
NEVER_SO = (1.5, 1.25)
EXCLAMATION = 0.292
QUESTION = 0.18
QUESTION_MAX = 0.96
ALPHA = 15.0

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_KEEP = "_keep"


def tokens(text: Column) -> Column:
    """Words without punctuation at their ends; marks that are no word (``:)``) stay whole."""

    words = F.split(text, SPACE)
    bare = F.transform(words, lambda w: F.btrim(w, F.lit(PUNCTUATION)))
    clean = F.zip_with(words, bare, lambda w, b: F.when(F.length(b) > 1, b).otherwise(w))
    return F.filter(clean, lambda w: F.length(w) > 1)


def _in_capitals(word: Column, lower: Column | None = None) -> Column:
    return ((F.lower(word) if lower is None else lower) != word) & (F.upper(word) == word)


def _occurrences(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _emphasis(text: Column) -> Column:
    exclamations = F.least(_occurrences(text, "!"), F.lit(4)) * EXCLAMATION
    questions = _occurrences(text, "?")
    asked = (
        F.when(questions > 3, F.lit(QUESTION_MAX))
        .when(questions > 1, questions * QUESTION)
        .otherwise(F.lit(0.0))
    )
    return F.coalesce(exclamations + asked, F.lit(0.0))


def _boost(before: Column, upper: Column, skip: set[str]) -> Column:
    """How much a preceding word strengthens (or weakens) a valence, without its sign."""
    up = [w for w in INTENSIFIERS if w not in skip]
    down = [w for w in DAMPENERS if w not in skip]
    loud = F.when(upper, F.lit(CAPITALS)).otherwise(F.lit(0.0))
    return (
        F.when(before.isin(up), loud + BOOST)
        .when(before.isin(down), loud - BOOST)
        .otherwise(F.lit(0.0))
    )


def _negates(before: Column, skip: set[str]) -> Column:
    return before.isin([w for w in NEGATORS if w not in skip]) | (
        before.contains("n't") & ~before.isin(sorted(skip) or [""])
    )


def _turn(distance: int, before: list[Column], skip: set[str]) -> Column:
    """Factor by which the word at this distance turns a valence around, or strengthens it."""
    negated = F.when(_negates(before[distance], skip), F.lit(NEGATION)).otherwise(F.lit(1.0))
    if distance == 0:
        return negated
    so = reduce(lambda a, b: a | b, [w.isin("so", "this") for w in before[:distance]])
    never_so = (before[distance] == "never") & so
    return F.when(never_so, F.lit(NEVER_SO[distance - 1])).otherwise(negated)


def _phrase(*words: Column) -> Column:
    """The words as a phrase; NULL where the text begins or ends among them."""
    return reduce(lambda a, b: F.concat(a, F.lit(" "), b), words)


def _idiom(w: list[Column], after: list[Column]) -> Column:
    """Valence of the idiom around a word, NULL without one; ``w`` goes back from the word, ``after`` on from it.

    Idioms are compared as written. One that begins with the word counts before those that end with it or before it.
    """
    ranked = [
        _phrase(w[0], after[0], after[1]), _phrase(w[0], after[0]), _phrase(w[1], w[0]), _phrase(w[2], w[1], w[0]),
        _phrase(w[2], w[1]), _phrase(w[3], w[2], w[1]), _phrase(w[3], w[2]),
    ]
    listed = F.create_map(*[F.lit(x) for pair in IDIOMS.items() for x in pair])
    return F.coalesce(*[F.try_element_at(listed, p) for p in ranked])


def score_texts(df: DataFrame, text: str, lexicon: DataFrame) -> DataFrame:
    """Replace the text column by ``compound``, a score between -1 and 1.

    ``lexicon`` is a table (token, valence). Every row of ``df`` stays, equal ones too; the other
    columns must be of types that can be grouped.
    """
    rest = [c for c in df.columns if c != text]
    modifiers = [*NEGATORS, *INTENSIFIERS, *DAMPENERS, "least"]
    valences = lexicon.groupBy(F.lower("token").alias("token")).agg(F.max("valence").alias("valence"))
    # A modifier that carries a valence of its own does not modify. At most as many rows as there
    # are modifiers.
    skip = {r.token for r in valences.filter(F.col("token").isin(modifiers)).collect()}

    # Rows that agree in all columns, text included, are told apart by the input partition they
    # come from and counted within it, so that copies are neither merged nor gathered in one task.
    # The work lies in the texts, and a feed may be few splits or one: rows are dealt out evenly before any is cut up.
    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    source = dealt.select(
        F.struct(*rest, F.xxhash64(text).alias("_text"), F.spark_partition_id().alias("_part"))
        .alias(_KEEP),
        _emphasis(F.col(text)).alias("emphasis"),
        tokens(F.col(text)).alias("tokens"),
    )
    shaped = source.select(
        _KEEP, "emphasis", "tokens",
        F.transform("tokens", F.lower).alias("lower"),
        # Capitals stand out only where some words are not written in capitals.
        F.exists("tokens", lambda w: ~_in_capitals(w)).alias("mixed"),
    )
    none = F.lit(None).cast("string")
    shifted = [F.concat(F.array(*[none] * n), "tokens").alias(f"w{n}") for n in range(1, 4)]
    # Zipping the tokens with shifted copies of themselves puts each beside those before it. The
    # place of the first "but" is found here, once per text and not once per token below.
    placed = shaped.select(
        _KEEP, "emphasis", "mixed", F.col("lower").alias("token"), F.col("tokens").alias("w0"),
        *shifted, *[F.slice("tokens", n + 1, F.array_size("tokens")).alias(f"n{n}") for n in (1, 2)],
        F.nullif(F.array_position("lower", F.lit("but")), F.lit(0)).alias("but"),
    )
    around = placed.select(
        _KEEP, "emphasis", "mixed", "but",
        F.posexplode_outer(F.arrays_zip("token", "w0", "w1", "w2", "w3", "n1", "n2")).alias("pos", "t"),
    ).select(_KEEP, "emphasis", "mixed", "but", "pos", "t.*")

    # Only words of the lexicon count; the first token stays too, so that no text is lost.
    place = F.coalesce(F.col("pos"), F.lit(0))
    hits = around.join(valences, "token", "left").filter(F.col("valence").isNotNull() | (place == 0))

    # A phrase around a word counts from the fourth word on, unless the third word before it has a valence. That one is
    # looked up where there is a phrase; elsewhere the word itself is, so that the rows stay spread.
    words = [F.col(f"w{n}") for n in range(4)]
    pairs = F.array(*[F.lit(d) for d in DAMPENERS if " " in d])
    damped = reduce(lambda a, b: a | b, [
        F.coalesce(F.array_contains(pairs, _phrase(words[k + 1], words[k])), F.lit(False)) for k in (1, 2)
    ])
    hits = hits.withColumn("idiom", _idiom(words, [F.col("n1"), F.col("n2")])).withColumn("damped", damped)
    phrased = F.col("w3").isNotNull() & (F.col("idiom").isNotNull() | F.col("damped"))
    third = valences.select(F.col("token").alias("third"), F.lit(True).alias("third_known"))
    hits = hits.withColumn("phrased", phrased).withColumn(
        "third", F.when(F.col("phrased"), F.lower("w3")).otherwise(F.col("token"))
    ).join(third, "third", "left").withColumn("phrased", F.col("phrased") & F.col("third_known").isNull())

    # An empty word stands for none: it is no modifier, and the code for NULL is spared. All of this becomes one method,
    # which the JVM compiles below 8,000 bytes only; beyond, every token of every text is interpreted (see the test).
    hits = hits.withColumns({f"w{n}": F.coalesce(f"w{n}", F.lit("")) for n in range(4)})
    hits = hits.select("*", *[F.lower(f"w{n}").alias(f"l{n}") for n in range(4)])
    hits = hits.select(
        "*", *[(F.col("mixed") & _in_capitals(F.col(f"w{n}"), F.col(f"l{n}"))).alias(f"u{n}") for n in range(4)]
    )
    before = [F.col("l1"), F.col("l2"), F.col("l3")]
    step = F.col("step")
    loud_word = F.col("valence") + F.signum("valence") * CAPITALS
    stepped = hits.withColumn("step", F.when(F.col("u0"), loud_word).otherwise(F.col("valence")))
    for distance in range(3):
        boost = _boost(before[distance], F.col(f"u{distance + 1}"), skip) * DISTANCE_DAMPING[distance]
        turn = _turn(distance, before, skip)
        stepped = stepped.withColumn("step", (step + F.signum(step) * boost) * turn)
    phrase = F.coalesce("idiom", "step") - F.when(F.col("damped"), F.lit(BOOST)).otherwise(F.lit(0.0))
    stepped = stepped.withColumn("step", F.when(F.col("phrased"), phrase).otherwise(step))
    if "least" not in skip:
        least = (F.col("l1") == "least") & ~F.coalesce(F.col("l2").isin("at", "very"), F.lit(False))
        stepped = stepped.withColumn("step", F.when(least, step * NEGATION).otherwise(step))
    # Words that only modify others carry no valence; a first "but" moves the weight behind it.
    modifier = F.col("token").isin([*INTENSIFIERS, *DAMPENERS]) | (
        (F.col("token") == "kind") & F.coalesce(F.lower("n1") == "of", F.lit(False))
    )
    weight = (
        F.when(F.col("pos") + 1 < F.col("but"), 0.5)
        .when(F.col("pos") + 1 > F.col("but"), 1.5)
        .otherwise(F.lit(1.0))
    )
    part = F.when(step.isNull() | modifier, F.lit(0.0)).otherwise(step * weight)
    scored = stepped.select(_KEEP, "emphasis", "pos", part.alias("part"))

    summed = scored.groupBy(_KEEP).agg(
        F.max("emphasis").alias("emphasis"),
        F.sum("part").alias("total"),
        F.count_if(F.coalesce(F.col("pos"), F.lit(0)) == 0).cast("int").alias("copies"),
    )
    mean = F.col("total") / F.col("copies")
    loud = mean + F.signum(mean) * F.col("emphasis")
    compound = F.round(loud / F.sqrt(loud * loud + ALPHA), 4)
    return summed.select(
        *[F.col(f"{_KEEP}.{c}").alias(c) for c in rest],
        compound.alias("compound"),
        F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("_copy"),
    ).drop("_copy")


def sentiment_class(df: DataFrame, text: str, lexicon: DataFrame) -> DataFrame:
    """Replace the text column by ``sentiment_analysis``: 0 negative, 1 neutral, 2 positive.

    Scores from -0.5 to 0.5 are neutral, as is a missing text.
    """
    scored = score_texts(df, text, lexicon)
    rest = [c for c in scored.columns if c != "compound"]
    return scored.select(
        *rest, (round_half_even(F.col("compound")) + 1).cast("int").alias("sentiment_analysis")
    )
