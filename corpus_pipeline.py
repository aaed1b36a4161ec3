"""From raw documents to packed training sequences.

Each stage works on all that its predecessor kept and is written as Parquet
before the next reads it. All but the last return the columns of documents.
SQL can express neither the MinHash, suffix nor packing stage, so run() is
tested against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.llm import minhash, packing, quality, repeats, secrets
from veritally.llm.common import table, written
from veritally.llm.queries import vocabulary

ORACLE_SQL = None
REPEATED = 200  # bytes; a passage of over 50 words has more, a sentence that documents share by chance has fewer


def recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with ``n_chars``, where there is one, brought in line with the text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    return quality.keep_good(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike by 0.8 or more."""
    return minhash.keep_one(docs)


def without_long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of ``REPEATED`` bytes that start anywhere else."""
    return recounted(repeats.remove(docs, settings=repeats.Settings(length=REPEATED)), docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret masked."""
    return recounted(secrets.redact(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", good_quality),
    ("minhash_near_dedup", without_near_copies),
    ("suffix_array_dedup", without_long_repeats),
    ("secret_scans", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
