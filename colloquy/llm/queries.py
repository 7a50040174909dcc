"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import alignment, embeddings, fingerprints, jaccard, language_id, language_model, mixing, oracles, packing, pages, quality, secrets, substrings, whitening


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_itq_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.98)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_documents(spark, sf_dir), percent=75, width=5)


def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), 2048, "byte_bpe_50k", encode_special_tokens=False)


def op4_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_documents(spark, sf_dir))


def op5_crf_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_documents(spark, sf_dir))


def op6_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(_documents(spark, sf_dir))


def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(_documents(spark, sf_dir))


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_documents(spark, sf_dir), target_entropy=0.97)


def op10_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(_documents(spark, sf_dir))


def op11_text_ratio_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_segment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(_documents(spark, sf_dir))


def op13_subspace_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=16)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_itq_near_vectors": op1_itq_near_vectors,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_best_two_fit": op3_best_two_fit,
    "op4_imatch_fingerprints": op4_imatch_fingerprints,
    "op5_crf_languages": op5_crf_languages,
    "op6_repeated_phrases": op6_repeated_phrases,
    "op7_rule_ensemble": op7_rule_ensemble,
    "op8_markov_secrets": op8_markov_secrets,
    "op9_temperature_mixing": op9_temperature_mixing,
    "op10_maxent_scores": op10_maxent_scores,
    "op11_text_ratio_pages": op11_text_ratio_pages,
    "op12_segment_alignment": op12_segment_alignment,
    "op13_subspace_whitening": op13_subspace_whitening,
}
#: Learned models, token ids and fingerprints have no SQL; tests hold them against brute force or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op1_itq_near_vectors": oracles.NEAR_VECTORS,
    "op2_jaccard_join": oracles.JACCARD,
    "op6_repeated_phrases": oracles.SUBSTRINGS,
}
