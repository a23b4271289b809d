"""From raw documents to packed sequences, one operator per stage.

Each stage takes (spark, docs, folder) and returns a table that is written as
Parquet and read again for the next stage. All but the last return the columns of
``documents``; the last returns one row per piece of a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.llm import decontaminate, near_dup, packing, pii, site_quality
from pairloom.llm.common import fresh_folder, read
from pairloom.llm.queries import VOCABULARY


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose own evidence, moved by that of their source and language, is good."""
    return site_quality.keep_good(docs, read(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8): the one
    with the smallest id."""
    return near_dup.drop_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows do not cover to a twentieth or more."""
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text."""
    clean = pii.redact(docs)
    if "n_chars" not in clean.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset."""
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_redaction", pii_redaction),
    ("best_fit_packing", best_fit_packing),
]

# A classifier that is fitted here, and the exchange of pieces, are beyond SQL; the
# tests run the stages against plain versions of what each may keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        place = fresh_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
