"""Queries of gates and corpus reports: session documents as VARIANT, rules and measures as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import gates
from colloquy.plans.registry import register
from colloquy.plans.views import table

_NUMBERS = [m for m in gates.corpus_measures() if m[1] in ("sum", "seconds") and m[0] != "total_duration_sec"]
#: A session document of each labelled or unlabelled text: figures that a report holds, from its length and labels.
_FIGURES = {m[2][2:]: ("n_chars % {0}" if m[1] == "sum" else "(n_chars % {0}) * 0.5e0").format(5 + 2 * i) for i, m in enumerate(_NUMBERS)}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    fields = {
        "verdict": "CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'risky' END", "selected_profile": "lang", "meeting_duration_sec": "n_chars / 15e0", "pipeline_status": "CASE WHEN quality IS NULL THEN 'partial' ELSE 'complete' END",
        "suggested_review_v1_available": "toxic = 1", "suggested_closure_status": "CASE WHEN n_chars % 3 = 0 THEN 'done' END", "remote_forbidden_status": "CASE WHEN n_chars % 4 = 0 THEN 'ok' ELSE 'missing' END", "remote_forbidden_gate_passed": "n_chars % 8 = 0",
        "remote_forbidden_asr_audio_candidate_gate_passed": "n_chars % 16 = 0", "risk_flags": "CASE WHEN quality = 0 THEN array('low_quality') ELSE array() END", **_FIGURES,
    }
    doc = F.parse_json(F.to_json(F.struct(*[F.expr(sql).alias(name) for name, sql in fields.items()])))
    return rows.select("source", "doc_id", doc.alias("doc"))


_SUMS = " UNION ALL ".join(f"SELECT source, '{m[0]}', NULL, {'round(' if m[1] == 'seconds' else ''}CAST(sum({_FIGURES[m[2][2:]]}) AS DOUBLE){', 3)' if m[1] == 'seconds' else ''} FROM d GROUP BY source" for m in _NUMBERS)
_COUNTS = " UNION ALL ".join(
    f"SELECT source, '{name}', NULL, CAST(count_if({sql}) AS DOUBLE) FROM d GROUP BY source"
    for name, sql in {
        "session_count": "TRUE", "complete_pipeline_count": "quality IS NOT NULL", "partial_or_incomplete_count": "quality IS NULL", "sessions_with_suggested_review_v1": "toxic = 1", "sessions_with_suggested_closure": "n_chars % 3 = 0",
        "remote_forbidden_sessions": "n_chars % 4 = 0", "remote_forbidden_gate_passed_sessions": "n_chars % 8 = 0", "remote_forbidden_asr_audio_candidate_gate_passed_sessions": "n_chars % 16 = 0", "sessions_with_risk_flags": "quality = 0",
    }.items()
)


@register("corpus_report", f"""WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)), r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM d WHERE quality = 0), x(source, measure, item, value) AS ({_SUMS} UNION ALL {_COUNTS}
 UNION ALL SELECT source, 'total_duration_sec', NULL, round(sum(n_chars / 15e0), 3) FROM d GROUP BY source UNION ALL SELECT source, 'total_duration_min', NULL, round(sum(n_chars / 15e0) / 60, 2) FROM d GROUP BY source UNION ALL SELECT source, 'median_duration_min', NULL, round(median(n_chars / 15e0) / 60, 2) FROM d GROUP BY source
 UNION ALL SELECT source, 'by_verdict', CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'risky' ELSE 'missing' END, CAST(count(*) AS DOUBLE) FROM d GROUP BY ALL UNION ALL SELECT source, 'by_selected_profile', lang, CAST(count(*) AS DOUBLE) FROM d GROUP BY ALL
 UNION ALL SELECT source, 'top_risk_sessions', CAST(doc_id AS VARCHAR), CAST(p AS DOUBLE) FROM r WHERE p <= 10) SELECT * FROM x""")
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of the corpus report, for each source."""
    return gates.corpus_report(_documents(spark, sf_dir), ["source"], "doc_id")


_GOOD = "n_good >= 0.5 * greatest(n_labelled, 1)"
_COUNTED = "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(quality) AS n_labelled, count(*) FILTER (quality = 1) AS n_good, count(*) FILTER (toxic = 1) AS n_toxic, count(DISTINCT lang) AS languages FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"


@register("semantic_gates", f"""WITH c AS ({_COUNTED}), e AS (SELECT source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE lang IS NOT NULL GROUP BY source), b AS (SELECT * FROM c LEFT JOIN e USING (source))
SELECT source, 'decision' AS gate, {_GOOD} AS passed FROM c UNION ALL SELECT source, 'all_source_gates', n_labelled > 0 AND languages > 1 AND n_toxic = 0 FROM c UNION ALL SELECT source, 'no_hard_failures', n_toxic = 0 FROM c UNION ALL SELECT source, 'integrity', languages > 1 AND n_toxic = 0 FROM c
 UNION ALL SELECT source, 'baseline_lineage', n_good % 2 = 0 FROM c UNION ALL SELECT source || '_baseline', 'queue_identity', b.n = e.n AND abs(b.chars - e.chars) < 1000 FROM b JOIN e USING (source) UNION ALL SELECT source, 'unknown_source', FALSE FROM c""")
def semantic_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of each source's document, and of its baseline's, which counts the texts whose language is known."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    c = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count("quality").alias("n_labelled"), F.count_if(F.col("quality") == 1).alias("n_good"), F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.countDistinct("lang").alias("languages"))
    e = table(spark, sf_dir, "documents").filter("lang is not null").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    queue = F.to_json(F.struct(F.struct(F.col("n").alias("items"), F.col("chars").alias("seconds")).alias("queue")))
    base = e.select(F.concat("source", F.lit("_baseline")).alias("source"), F.sha2("source", 256).alias("sha256"), F.parse_json(queue).alias("doc"))
    flags = F.struct((F.col("n_labelled") > 0).alias("labelled"), (F.col("languages") > 1).alias("languages"), (F.col("n_toxic") == 0).alias("clean"))
    hard = F.when(F.col("n_toxic") > 0, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>"))
    body = F.struct(F.when(F.expr(_GOOD), "PROMOTE").otherwise("KEEP").alias("decision"), flags.alias("gates"), hard.alias("hard_failures"), F.struct(F.col("n").alias("items"), F.col("chars").alias("seconds")).alias("summary"), F.when(F.col("n_good") % 2 == 0, F.sha2("source", 256)).alias("baseline_sha256"))
    own = c.select("source", F.lit(None).cast("string").alias("sha256"), F.parse_json(F.to_json(body)).alias("doc"))
    baseline = F.concat("source", F.lit("_baseline"))
    none = F.array().cast("array<string>")

    def condition(gate: str, place: int, kind: str, path: str, expected=none, source=F.col("source"), other=None, other_path: str | None = None, tolerance: float = 0.0):
        return F.struct(source.alias("source"), F.lit(gate).alias("gate"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), F.lit(path).alias("path"), expected.alias("expected"), (other if other is not None else F.lit(None).cast("string")).alias("other"), F.lit(other_path).cast("string").alias("other_path"), F.lit(tolerance).alias("tolerance"))

    table_ = F.array(
        condition("decision", 0, "in", "$.decision", F.array(F.lit("PROMOTE"))),
        condition("all_source_gates", 0, "every", "$.gates"),
        condition("no_hard_failures", 0, "empty", "$.hard_failures"),
        condition("integrity", 0, "is", "$.gates.languages", F.array(F.lit("true"))),
        condition("integrity", 1, "all", "$.gates", F.array(F.lit("labelled"), F.lit("languages"))),
        condition("baseline_lineage", 0, "hash", "$.baseline_sha256", other=baseline),
        condition("queue_identity", 0, "same", "$.queue.items", source=baseline, other=F.col("source"), other_path="$.summary.items"),
        condition("queue_identity", 1, "same", "$.queue.seconds", source=baseline, other=F.col("source"), other_path="$.summary.seconds", tolerance=999.5),
        condition("unknown_source", 0, "is", "$.nothing", F.array(F.lit("true"))),
    )
    conditions = c.select(F.explode(table_).alias("r")).select("r.*")
    return gates.apply_gates(own.unionByName(base), conditions).select("source", "gate", "passed")
