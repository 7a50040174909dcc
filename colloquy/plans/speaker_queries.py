"""Queries of speaker clustering, enrolment and evidence stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import folds, linkage, speakers
from colloquy.plans.note_queries import LEX
from colloquy.plans.registry import register
from colloquy.plans.views import count, evidence, evidence_sql, flag, live_turns, pick, share, table

_PARTS = "p AS (SELECT source AS k, lang AS l, n_chars % 3 + CASE WHEN lang = 'en' THEN 10 ELSE 0 END AS r FROM documents)"
_ARI = """c AS (SELECT k, l, r, count(*) AS n FROM {p} GROUP BY ALL), s AS (SELECT k, sum(n * (n - 1) / 2.0) AS same, sum(n) AS z FROM c GROUP BY k), a AS (SELECT k, sum(n * (n - 1) / 2.0) AS a FROM (SELECT k, l, sum(n) AS n FROM c GROUP BY ALL) GROUP BY k), b AS (SELECT k, sum(n * (n - 1) / 2.0) AS b FROM (SELECT k, r, sum(n) AS n FROM c GROUP BY ALL) GROUP BY k),
ari AS (SELECT k, CASE WHEN z < 2 OR (a + b) / 2 = a * b / (z * (z - 1) / 2.0) THEN 1e0 ELSE (same - a * b / (z * (z - 1) / 2.0)) / ((a + b) / 2 - a * b / (z * (z - 1) / 2.0)) END AS ari FROM s JOIN a USING (k) JOIN b USING (k))"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("n_chars") % 3 + F.when(F.col("lang") == "en", 10).otherwise(0)
    return table(spark, sf_dir, "documents").select(F.col("source").alias("k"), F.col("lang").alias("l"), r.alias("r"))


@register("adjusted_rand", f"WITH {_PARTS}, {_ARI.format(p='p')} SELECT k, round(ari, 9) AS ari FROM ari")
def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.adjusted_rand(_parts(spark, sf_dir), ["k"], "l", "r").select("k", F.round("ari", 9).alias("ari"))


@register("chunk_consistency", f"""WITH {_PARTS}, bl AS (SELECT k, l, count(*) >= 10 AS x FROM p GROUP BY ALL), br AS (SELECT k, r, count(*) >= 10 AS y FROM p GROUP BY ALL), q AS (SELECT p.*, x, y FROM p JOIN bl USING (k, l) JOIN br USING (k, r)), g AS (SELECT * FROM q WHERE x AND y), {_ARI.format(p='g')},
v AS (SELECT k, count(*) FILTER (x) AS n, count(*) FILTER (x AND y) AS m FROM q GROUP BY k) SELECT k, round(CASE WHEN m < 2 THEN 0e0 ELSE ari END, 9) AS ari, CASE WHEN n > 0 THEN CAST(m AS DOUBLE) / n ELSE 0e0 END AS coverage FROM v LEFT JOIN ari USING (k)""")
def chunk_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.chunk_consistency(_parts(spark, sf_dir), "k", "l", "r").withColumn("ari", F.round("ari", 9))


GRID = [0.5, 0.6, 0.7, 0.8, 0.9]


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as units of a meeting for each hundred ids: ten seconds apart, from two to six seconds long."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.expr("vec_id div 100").alias("meeting"), (F.col("vec_id") % 100 * 10.0).alias("start"))
    return e.withColumn("end", F.col("start") + 2 + F.col("vec_id") % 5)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.partition_candidates(_units(spark, sf_dir), "meeting", "vec_id", "embedding", "start", "end", GRID, chunk_seconds=250, merge_distance=0.5, least=(5, 15, 60, 0.3))


@register("chunk_replay")
def chunk_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far clusters of whole meetings, at each distance, are those of a replay by chunks of 250 seconds."""
    return _candidates(spark, sf_dir)


@register("nearest_distance_pick")
def nearest_distance_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of each meeting at which its vectors fall into stable speakers, three expected."""
    rows = linkage.viable(_candidates(spark, sf_dir).withColumn("expected", F.lit(3)), "expected", speech=0.3, ari=0.5, coverage=0.5)
    return speakers.nearest_partition(rows, "meeting", "expected", GRID[0])


_ENROL = {"session": count(7, 20), "role": pick(11, "Me", "Me", "Colleagues"), "duration_sec": "25 * " + share(13), "needs_review": flag(17, 6), "words": count(19, 20), "local_only": share(23), "remote_active": "0.4 * " + share(29)}


@register("enrollment_build", f"""WITH {evidence_sql(_ENROL)}, s AS (SELECT session, id, round(100 * local_only - 80 * remote_active + 2 * least(12, duration_sec) + least(12, words), 6) AS enrol_score FROM x WHERE role = 'Me' AND duration_sec BETWEEN 1 AND 20 AND NOT needs_review AND words >= 2 AND local_only >= 0.55 AND remote_active <= 0.15)
SELECT session, id, enrol_score FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY enrol_score DESC, id) AS r FROM s) WHERE r <= 12""")
def enrollment_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.enrollment(evidence(spark, sf_dir, _ENROL), "session", "id")


_MICRO = {"ms": "500 + (" + count(7, 4000) + ")", "chars": count(11, 60), "words": count(13, 6), "baseline": flag(17, 3), "raw_support": f"CASE WHEN {flag(19, 4)} THEN NULL ELSE {share(23)} END", "filtered_support": f"CASE WHEN {flag(29, 4)} THEN NULL ELSE {share(31)} END", "families": f"CASE WHEN {flag(19, 4)} OR {flag(29, 4)} THEN NULL ELSE {share(37)} END"}
_BOTH = "(coalesce(raw_support >= 0.72, FALSE) AND coalesce(filtered_support >= 0.72, FALSE))"


@register("micro_stability", f"""WITH {evidence_sql(_MICRO)}, b AS (SELECT id, list_filter([CASE WHEN ms <= 1250 AND chars * 1000.0 / ms > 24 AND NOT {_BOTH} THEN 'implausible_short_island_speech_rate' END, CASE WHEN ms <= 1250 AND baseline AND NOT coalesce(raw_support >= 0.72, FALSE) AND NOT coalesce(filtered_support >= 0.72, FALSE) THEN 'baseline_only_selection_without_canonical_support' END,
 CASE WHEN ms <= 1250 AND words >= 2 AND NOT {_BOTH} AND families < 0.45 THEN 'short_island_source_disagreement' END], lambda r: r IS NOT NULL) AS reasons FROM x) SELECT id, reasons, CASE WHEN len(reasons) > 0 THEN 'needs_review' ELSE 'stable' END AS status FROM b""")
def micro_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.micro_stability(evidence(spark, sf_dir, _MICRO)).select("id", "reasons", "status")


@register("agglomerative")
def agglomerative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the vectors of each hundred ids, as units of a meeting."""
    e = table(spark, sf_dir, "embeddings").withColumn("meeting", F.expr("vec_id div 100"))
    return linkage.agglomerative(e, "meeting", "vec_id", "embedding", distance=0.5)


@register("audio_judge")
def audio_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of five groups of labelled vectors judged by a model of the other four."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id % 5").alias("fold"), "embedding", (F.col("label") % 2).alias("y")).filter("y is not null and embedding is not null")
    return speakers.leave_one_out(e, "fold", "embedding", "y").select("vec_id", "y", "predicted", "confidence")


@register("topic_blocks")
def topic_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.operators import notes

    turns = live_turns(spark, sf_dir).withColumn("needs_review", F.col("id") % 5 == 0).withColumn("unresolved", F.lit(False))
    rows = notes.salience(turns, LEX).select("session", "id", "role", (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"), (F.col("id") % 4 == 0).alias("marker"), "salience")
    return folds.topic_blocks(rows, ["session"])
