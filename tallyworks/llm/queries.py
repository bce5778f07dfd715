"""The corpus operators applied to the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    byte_bpe, context_tree, language_id, merkle, mixing, order_minhash, pii, prefix_forest, quality, resample,
    sharding, simhash, suffix_dedup,
)
from .common import id_crc

RANKS = "byte_bpe_multi_50k.tiktoken"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Learns from the rows that are not held out, predicts every row from its text alone."""
    docs = documents(spark, folder)
    held = id_crc() % 4 == 2
    model = language_id.train(docs, ~held)
    return language_id.predict(docs.select("doc_id", held.alias("held_out"), "text"), model)


def op2_hash_tree_shards(spark: SparkSession, folder: str) -> DataFrame:
    """24 shards in 2 regions of 3 racks of 4."""
    return sharding.assign(documents(spark, folder), sharding.Tree.even(2, 3, 4))


def op3_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    held = id_crc() % 7 == 2
    return context_tree.score(documents(spark, folder), ~held, held)


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path(RANKS))
    return byte_bpe.digest(documents(spark, folder), ranks, public_tokenizers.PATTERN)


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return quality.judge(documents(spark, folder).select("doc_id", "text", "lang"), labels).drop("lang")


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.digest(documents(spark, folder))


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digest(documents(spark, folder))


def op8_prefix_forest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return prefix_forest.search(vectors, F.col("id") % 50 == 0, "vec_id", "embedding")


def op10_sanitise(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(documents(spark, folder))


def op9_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.shares(documents(spark, folder), (3, 1, 2))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op11_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every text and of its edited form."""
    return order_minhash.digest(documents(spark, folder))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves, proofs and the check of rows of which some have lost their line breaks."""
    return merkle.digest(documents(spark, folder))


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Documents drawn towards the benchmark's distribution of words."""
    docs = documents(spark, folder).select("doc_id", "text")
    found = resample.score(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_hash_tree_shards": op2_hash_tree_shards,
    "op3_context_tree": op3_context_tree,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash": op6_simhash,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_prefix_forest": op8_prefix_forest,
    "op9_mix_sources": op9_mix_sources,
    "op10_sanitise": op10_sanitise,
    "op11_order_minhash": op11_order_minhash,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_importance_resampling": op13_importance_resampling,
}
# XXH64 draws, byte merges, models and sorted suffixes are beyond SQL: the queries are
# tested against brute force, held-out accuracy and exact round trips.
SQL: dict[str, str] = {}
