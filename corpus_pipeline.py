"""From raw documents to packed training sequences: five stages, each written as Parquet before the next begins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import jaccard, mixing, packing, quality, secrets
from colloquy.storage import materialize


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores under 0.5 go.

    Rows are judged one by one, so repeated rows stay or go together; a null text counts as empty and is scored as well, a
    null doc_id takes no part in training. Without labels of both kinds the ensemble has one score for all. An empty table
    gives no rows.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays.

    Of repeated rows one stays. Rows with one doc_id and different texts are judged apart, a null doc_id comes last in its
    group. Rows without words, null texts included, are no copies of anything. An empty table gives no rows.
    """
    return jaccard.drop_copies(docs, percent=75, width=5)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts give way to a mark, and n_chars is counted anew.

    Every row stays, with its doc_id whatever that is; null texts stay null, empty ones empty, repeated rows equal. Spans
    that overlap give way together. An empty table gives no rows.
    """
    return secrets.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Smaller sources are repeated, up to one and a half times; every document stays.

    A null source is a source of its own; null and empty texts have no tokens and stay once. Repeated rows count one by one.
    An empty table gives no rows.
    """
    return mixing.repeat_small_sources(docs, repetition=1.5)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 2048 tokens.

    A null or empty text is one piece of length 1; repeated rows are packed once each. An empty table gives no rows.
    """
    return packing.pack_documents(docs, 2048, "byte_bpe_50k", encode_special_tokens=False)


STAGES = [("quality", drop_poor), ("near_duplicates", drop_near_copies), ("secrets", redact_secrets), ("mixing", mix_sources), ("packing", pack)]

#: Learned models and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that the stages keep, in their places. Each stage is written before the next one begins, so a lost executor costs one stage at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
