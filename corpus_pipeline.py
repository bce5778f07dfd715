"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next one's ``docs``. All but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyworks.llm import byte_bpe, mixing, pii, quality, simhash
from tallyworks.llm.queries import RANKS
from tallyworks.sources.tables import shared_folder

WEIGHTS = (3, 1, 2)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return simhash.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers and the terms that disclose them are replaced; ``n_chars`` follows the text."""
    clean = pii.sanitise(docs)
    if "n_chars" not in clean.columns:
        return clean
    kind = clean.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.length("text").cast(kind))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.mix(docs, WEIGHTS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text; ``round_trip`` tells that they decode to its bytes."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path(RANKS))
    pattern = public_tokenizers.PATTERN
    rows = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    encoded = byte_bpe.encode(rows, ranks, pattern).withColumn("kept_ids", F.col("ids"))
    decoded = byte_bpe.decode(encoded, ranks)
    return decoded.select(
        "doc_id",
        F.col("kept_ids").alias("ids"),
        F.size("kept_ids").cast("long").alias("n_tokens"),
        (F.sha2("bytes", 256) == F.col("text_sha256")).alias("round_trip"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixture),
    ("tokens", tokens),
]

# Hashes and byte merges are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
