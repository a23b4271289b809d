"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairloom.llm import decontaminate, huffman, main_text, near_dup, packing, pii, quality_rules, repeats, site_quality, spelling, turns, url_filter, warc
from pairloom.llm.common import read
from pairloom.llm.sql import SQL

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_spans(read(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s.base)

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in pii.KINDS]
    return found.select(F.col("row.doc_id").alias("doc_id"), *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(read(spark, folder, "pages"), rules)


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    rows = warc.archive_round_trip(read(spark, folder, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, folder, "documents")).drop("kept")


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(read(spark, folder, "documents"), VOCABULARY)


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality_rules.judge_quality(read(spark, folder, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_matches(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    sha = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return decontaminate.judge(found).select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", "n_items", sha, "contaminated")


def op7_minhash(spark: SparkSession, folder: str) -> DataFrame:
    rows = near_dup.components(read(spark, folder, "documents"), k=2)
    kept = F.col("doc").eqNullSafe(F.col("component")).alias("kept")
    return rows.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), kept)


def op8_token_output(spark: SparkSession, folder: str) -> DataFrame:
    return huffman.token_round_trip(read(spark, folder, "documents"), VOCABULARY)


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return site_quality.classify(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op11_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extract(read(spark, folder, "pages"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    rows = spelling.spelling_variants(read(spark, folder, "documents"))
    return rows.select("word", "form", "root", "n", "n_near", "form_n")


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "conversations")
    return turns.repair(turns.damaged(rows), rows.select("conv_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_url_filter": op2_url_filter,
    "op3_repeated_strings": op3_repeated_strings,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_decontamination": op6_decontamination,
    "op7_minhash": op7_minhash,
    "op8_token_output": op8_token_output,
    "op9_warc": op9_warc,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_html_extraction": op11_html_extraction,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_conversation_repair": op13_conversation_repair,
}

__all__ = ["QUERIES", "SQL"]
