"""The corpus pipeline: language ID, exact, near and substring deduplication, then packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes a stage's rows to the shared folder and
reads them again as the next one's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import fresh_path
from weft.llm.exact_dedup import drop_exact_duplicates
from weft.llm.language_id import predicted, train
from weft.llm.near_dedup import drop_near_duplicates
from weft.llm.packing import pack_documents
from weft.llm.substring_dedup import keep_unique_passages


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, or without text, go."""
    verdict = docs.withColumn("__language", predicted(train(docs), F.col("text")))
    return verdict.where(F.col("__language.lang_pred") != "und").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, that of the largest doc_id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of five-word shingles, that of the smallest doc_id."""
    return drop_near_duplicates(docs, width=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages cut out; a document that had nothing else goes. ``n_chars`` follows the text."""
    return keep_unique_passages(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens lie in sequences of at most 2048."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: Language inference, near-duplicate components and tokens can't be expressed in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
