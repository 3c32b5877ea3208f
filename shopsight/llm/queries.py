"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopsight.llm import common as C
from shopsight.llm import (conversation_repair, imatch, lm_scoring, mixing, ngram_join, quality, secret_scan, sharding, source_divergence,
                           token_store, toxicity, warc_zip, winnowing)


SHARDS = [f"shard-{i:03d}" for i in range(256)]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(C.documents(spark, sf_dir).select("doc_id"), "doc_id", SHARDS)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(C.documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_likeness(C.documents(spark, sf_dir))


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(C.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scores(C.documents(spark, sf_dir))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.contamination(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("item_ids", 256).alias("items_sha256"),
                        "contaminated")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc_zip.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc_zip.read_archives(archives).drop("url")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = token_store.write_ids(C.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read_ids(blocks, with_ids=False)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_repair.repair(conversation_repair.damaged(rows))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(C.documents(spark, sf_dir))


def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(C.documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_sharding, op2_ngram_jaccard_join, op3_toxicity, op4_document_fingerprints, op5_mixing_sources, op6_lm_scoring, op7_benchmark_decontamination, op8_warc,
        op9_quality_classifier, op10_token_id_output, op11_conversation_repair, op12_source_divergence, op13_secret_scans)}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_benchmark_decontamination": winnowing.ORACLE.format(documents="documents")
        + "SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM judged",
        "op8_warc": warc_zip.ORACLE,
        "op11_conversation_repair": conversation_repair.ORACLE,
        "op12_source_divergence": source_divergence.ORACLE,
    }
