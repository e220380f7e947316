"""From raw documents to token ids: quality, near copies, repeated passages, benchmark leaks, encoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from belfry.llm import byte_dedup, leaks, near_dups, quality, word_bpe
from belfry.llm.queries import tokenizer_path
from belfry.session import written


PASSAGE = 200  # bytes; of 51 words in 8000 texts of check_s over 99 % hold more (0.1 % less than 152, 1 % less than 250)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of at least 0.3)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    return quality.with_quality_score(docs, model, score="__score").where(F.col("__score") >= 0.3).drop("__score")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near copies."""
    return near_dups.one_per_class(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of ``PASSAGE`` bytes or more that also occur elsewhere; ``n_chars`` follows the text."""
    cut = byte_dedup.with_repeats_removed(docs, PASSAGE, keep_text=True)
    return (cut.withColumn("text", F.col("__cut.kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    return leaks.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number, and the text they decode to."""
    return word_bpe.with_codes(docs.select("doc_id", "lang", "source", "text"), tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near-dedup", one_of_each),
    ("repeats", cut_repeats),
    ("benchmarks", without_benchmarks),
    ("encoding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
