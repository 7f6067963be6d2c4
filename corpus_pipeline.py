"""From raw documents to token ids: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import decontaminate, mixing, quality, simhash, token_store
from shelfwise.llm.storage import stored
from shelfwise.sources.scratch import scratch_path

#: SQL cannot express the first, second, fourth and fifth stage; ``tests/llm`` has their brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the weighed rules keep, fitted on these documents.

    A text is counted once: the rows are stored with their counts, fitted and judged from there. A NULL or empty text
    goes, repeated rows are judged alike, and all columns stay as they were.
    """
    counted = stored(quality.text_statistics(docs), "statistics")
    model = quality.fit_label_model(stored(quality.vote_patterns(counted), "patterns"))
    return quality.judge_quality(counted, model).filter("kept").select("row.*")


def simhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id.

    Texts without words are one group; of repeated rows one stays.
    """
    return simhash.keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark. A NULL or empty text has none and stays, and so do repeated rows."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a document as often as it is taken, its columns as they were. A NULL source is a source."""
    return mixing.write_out(mixing.mix_sources(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document of the mix, written in the library's format and read back.

    A NULL text is empty, its only id the end; repeated rows are each written. Columns but id and text are not.
    """
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    token_store.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_store.read_tokens(spark, path).select(
        "doc_id", "start", F.expr("length(tokens) div 4").alias("n_tokens"), F.crc32("tokens").alias("ids_crc32")
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("simhash_neardup", simhash_neardup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
