"""All query modules; importing this one registers their queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.plans import bundle_queries, decision_queries, gate_queries, interval_queries, ladder_queries, matching_queries, note_queries, review_queries, session_queries, speaker_queries, text_queries  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps between tracks of each day, with their kinds."""
    return session_queries.cross_role_overlap_join(spark, sf_dir)
