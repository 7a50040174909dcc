"""Queries of the decision ladders, each on evidence columns derived from the events, with independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import decisions as dc
from colloquy.operators import review as rv
from colloquy.plans.registry import register
from colloquy.plans.views import count, evidence, evidence_sql, flag, pick, share


def _ladder(name: str, fields: dict[str, str], sql: str, operator: Callable[[DataFrame], DataFrame], *columns: str) -> None:
    """Registers operator over the fields; sql: the columns over x(id, fields)."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(evidence(spark, sf_dir, fields)).select("id", *columns)

    register(name, f"WITH {evidence_sql(fields)} SELECT id, {sql} FROM x")(query)


_ladder(
    "use_gate",
    {"pipeline_complete": "NOT (" + flag(7, 11) + ")", "verdict": pick(13, "good", "risky", "good", "failed", "usable_with_review", "good", "good"), "cleaned_profile": "NOT (" + flag(17, 5) + ")", "cleanup_attempted": flag(19, 2), "residual_risk": flag(23, 6), "burden_sec": share(29) + " * 400", "duration_sec": "3600e0 * (" + count(31, 4) + ")", "n_flags": count(37, 3)},
    """CASE WHEN NOT pipeline_complete THEN 'pipeline_incomplete' WHEN verdict = 'failed' OR (verdict = 'risky' AND NOT residual_risk) THEN 'do_not_use_without_manual_review'
 WHEN NOT cleaned_profile THEN CASE WHEN cleanup_attempted THEN 'review_first' ELSE 'pipeline_incomplete_review_first' END WHEN residual_risk THEN 'review_first'
 WHEN CASE WHEN duration_sec > 0 THEN burden_sec / duration_sec ELSE 0 END <= 0.025 AND n_flags = 0 THEN 'ready_for_notes' WHEN CASE WHEN duration_sec > 0 THEN burden_sec / duration_sec ELSE 0 END <= 0.08 THEN 'review_first' ELSE 'do_not_use_without_manual_review' END AS use_gate""",
    dc.use_gate,
    "use_gate",
)
_ladder(
    "review_burden",
    {"error_sec": count(7, 90), "judge_sec": count(11, 50), "notes_error_sec": f"CASE WHEN {flag(13, 3)} THEN NULL ELSE {count(17, 40)} END", "notes_judge_sec": f"CASE WHEN {flag(19, 4)} THEN NULL ELSE {count(23, 30)} END", "recall_review_sec": count(29, 12), "order_review_sec": count(31, 7), "scope_remaining_sec": count(37, 120), "duration_sec": "600 * (" + count(41, 5) + ")", "needs_review": count(43, 9), "notes_needs_review": count(47, 6)},
    """CAST(greatest(coalesce(notes_error_sec, error_sec) + coalesce(notes_judge_sec, judge_sec) + recall_review_sec + order_review_sec, scope_remaining_sec) AS DOUBLE) AS notes_burden_sec,
 CAST(greatest(error_sec + judge_sec + recall_review_sec + order_review_sec, scope_remaining_sec) AS DOUBLE) AS transcript_burden_sec,
 CASE WHEN duration_sec > 0 THEN round(greatest(coalesce(notes_error_sec, error_sec) + coalesce(notes_judge_sec, judge_sec) + recall_review_sec + order_review_sec, scope_remaining_sec) / CAST(duration_sec AS DOUBLE), 6) ELSE 0 END AS notes_burden_ratio,
 list_filter([CASE WHEN greatest(error_sec + judge_sec + recall_review_sec + order_review_sec, scope_remaining_sec) > greatest(coalesce(notes_error_sec, error_sec) + coalesce(notes_judge_sec, judge_sec) + recall_review_sec + order_review_sec, scope_remaining_sec) THEN 'full_transcript_review_required' END, CASE WHEN needs_review > notes_needs_review THEN 'full_transcript_needs_review_required' END], lambda r: r IS NOT NULL) AS export_reasons""",
    dc.review_burden,
    "notes_burden_sec",
    "transcript_burden_sec",
    "notes_burden_ratio",
    "export_reasons",
)
_RISK = {
    "verdict": pick(7, "good", "risky", "failed", "good", "good"), "profile": pick(11, "reviewed_v1", "agent_reviewed_v1", "audit_cleanup_v4"), "cleaned_profile": "NOT (" + flag(13, 4) + ")", "decision_gates_passed": flag(17, 2),
    "scope_complete": f"CASE WHEN {flag(19, 5)} THEN NULL ELSE {flag(23, 2)} END", "scope_remaining_sec": count(29, 3), "decisions_applied": count(31, 2), "decisions_rejected": count(37, 2), "decisions_conflicts": count(41, 2),
    "long_crossings": count(43, 2), "golden_failures": count(47, 3), "recall_blocking": flag(53, 3), "order_blocking": flag(59, 4), "local_recall": share(61), "recall_audit": pick(67, "ok", "failed"),
    "notes_needs_ratio": f"CASE WHEN {flag(71, 3)} THEN NULL ELSE {share(73)} END", "needs_ratio": share(79), "harmful_sec": count(83, 40), "review_sec": count(89, 200), "duration_sec": "600 * (" + count(97, 3) + ")",
    "notes_error_count": count(101, 5), "notes_error_sec": count(103, 14), "leak_protect_items": count(107, 2), "leak_stale_items": count(109, 2), "notes_judge_count": count(113, 25), "notes_judge_sec": count(127, 70),
}
_PARTIAL = "coalesce(scope_complete = FALSE AND scope_remaining_sec > 0 AND decisions_applied > 0 AND decisions_rejected = 0 AND decisions_conflicts = 0, FALSE)"
_ladder(
    "risk_flags",
    _RISK,
    f"""list_filter([CASE WHEN verdict = 'risky' THEN 'verdict:risky' WHEN verdict = 'failed' THEN 'verdict:failed' END, CASE WHEN NOT cleaned_profile THEN 'no_audit_cleanup_profile' END,
 CASE WHEN profile = 'reviewed_v1' AND NOT decision_gates_passed AND NOT {_PARTIAL} THEN 'review_decisions_gates_failed' END, CASE WHEN profile = 'reviewed_v1' AND scope_complete = FALSE THEN 'partial_review_scope' END,
 CASE WHEN profile = 'agent_reviewed_v1' AND NOT decision_gates_passed AND NOT {_PARTIAL} THEN 'agent_review_decisions_gates_failed' END,
 CASE WHEN long_crossings > 0 THEN 'unrepaired_long_mic_crossings' END, CASE WHEN golden_failures > 0 THEN 'golden_phrase_fail' END, CASE WHEN recall_blocking THEN 'local_recall_possible_lost_me' END, CASE WHEN order_blocking THEN 'transcript_order_risk' END,
 CASE WHEN local_recall < 0.9 AND recall_audit <> 'ok' THEN 'low_local_recall' END, CASE WHEN notes_needs_ratio > 0.12 THEN 'notes_high_needs_review_ratio' END, CASE WHEN notes_needs_ratio IS NULL AND needs_ratio > 0.12 THEN 'high_needs_review_ratio' END,
 CASE WHEN duration_sec > 0 AND harmful_sec > 0.03 * duration_sec THEN 'high_harmful_overlap_ratio' END, CASE WHEN duration_sec > 0 AND review_sec > 0.12 * duration_sec THEN 'high_review_overlap_ratio' END,
 CASE WHEN notes_error_count >= 3 OR notes_error_sec >= 10 THEN 'notes_audio_review_probable_errors' END, CASE WHEN leak_protect_items > 0 AND (notes_error_count > 0 OR notes_error_sec > 0) THEN 'remote_leak_segment_repair_candidates' END,
 CASE WHEN leak_stale_items > 0 THEN 'stale_remote_leak_segment_plan' END, CASE WHEN notes_judge_count >= 20 OR notes_judge_sec >= 60 THEN 'notes_need_stronger_audio_judge' END], lambda r: r IS NOT NULL) AS risk_flags""",
    dc.risk_flags,
    "risk_flags",
)
_ITEM = {
    "source": pick(7, "audio", "local_recall", "transcript_text", "transcript_order", "audio", "audio", "audio", "audio"), "label": pick(11, "remote_duplicate", "asr_noise", "remote_leak", "lost_me", "double_talk", "timing_overlap", "uncertain", "probable_order_risk", "needs_review", "local_recall_needs_review", "local_recall_repair_inserted"),
    "verdict": pick(13, "probable_transcript_error", "needs_stronger_audio_judge", "needs_transcript_order_review"), "confidence": share(17), "duration_sec": "(" + count(19, 90) + ") / 10e0", "me_coverage": share(23), "similarity": share(29), "containment": share(31),
}
_HINT = "(me_coverage >= 0.8 AND (similarity >= 0.92 OR containment >= 0.75))"
_ERR = "verdict = 'probable_transcript_error'"
_ladder(
    "priority_score",
    _ITEM,
    f"""round(duration_sec + confidence * 10 + CASE WHEN {_ERR} THEN 100 WHEN verdict = 'needs_stronger_audio_judge' THEN 70 ELSE 0 END + CASE WHEN label IN ('remote_duplicate', 'asr_noise') THEN 12 WHEN label IN ('remote_leak', 'lost_me', 'uncertain') THEN 8 ELSE 0 END, 3) AS priority""",
    dc.priority,
    "priority",
)
_LANE = f"""CASE WHEN source IN ('local_recall', 'local_recall_repair') OR label IN ('lost_me', 'local_recall_needs_review', 'local_recall_repair_inserted') THEN 'check_local_recall' WHEN source = 'transcript_text' THEN 'check_transcript_text'
 WHEN source = 'transcript_order' OR label = 'probable_order_risk' THEN 'check_transcript_order' WHEN label = 'remote_duplicate' AND {_ERR} AND {_HINT} THEN 'fast_confirm_drop' WHEN label = 'remote_duplicate' AND {_ERR} THEN 'check_unique_me_content'
 WHEN label = 'asr_noise' AND {_ERR} THEN 'fast_confirm_drop' WHEN label = 'remote_leak' THEN 'check_unique_me_content' WHEN label IN ('double_talk', 'timing_overlap') THEN 'confirm_benign' ELSE 'classify_audio' END"""
_ladder("review_lane", _ITEM, f"{_LANE} AS review_lane", dc.review_lane, "review_lane")
_ACTION = f"""CASE WHEN label = 'remote_duplicate' AND {_ERR} THEN CASE WHEN {_HINT} THEN 'confirm_drop_or_keep_me' ELSE 'check_unique_me_content' END WHEN label = 'asr_noise' AND {_ERR} THEN 'confirm_drop_or_keep_me' WHEN label = 'remote_leak' THEN 'check_unique_me_content'
 WHEN label = 'lost_me' THEN 'check_lost_local_speech' WHEN label = 'local_recall_needs_review' THEN 'check_local_recall_island' WHEN label = 'local_recall_repair_inserted' THEN 'check_inserted_local_recall_repair'
 WHEN label IN ('probable_order_risk', 'needs_review') AND source = 'transcript_order' THEN 'check_transcript_order' WHEN label IN ('double_talk', 'timing_overlap') THEN 'confirm_benign_overlap' ELSE 'classify_audio' END"""
_ladder("review_action", _ITEM, f"{_ACTION} AS review_action", dc.review_lane, "review_action")
_ladder(
    "suggested_decision",
    _ITEM,
    f"""CASE WHEN label = 'remote_duplicate' AND {_ERR} THEN CASE WHEN {_HINT} THEN 'drop_me' ELSE 'needs_review' END WHEN label = 'asr_noise' AND {_ERR} THEN 'drop_me' WHEN label IN ('double_talk', 'timing_overlap') THEN 'keep_me' ELSE 'needs_review' END AS decision,
 CASE WHEN label = 'remote_duplicate' AND {_ERR} THEN CASE WHEN {_HINT} AND confidence >= 0.9 THEN 'high' ELSE 'medium' END WHEN label = 'asr_noise' AND {_ERR} THEN CASE WHEN confidence >= 0.9 THEN 'high' ELSE 'medium' END
 WHEN label IN ('remote_leak', 'lost_me', 'local_recall_repair_inserted', 'probable_order_risk') THEN 'medium' ELSE 'low' END AS decision_confidence""",
    dc.suggested_decision,
    "decision",
    "decision_confidence",
)


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.priority(dc.review_lane(evidence(spark, sf_dir, _ITEM | {"session": count(37, 40), "me_id": f"CASE WHEN {flag(41, 9)} THEN NULL ELSE {count(43, 6)} END"})))


_QUEUE = f"""WITH {evidence_sql(_ITEM | {"session": count(37, 40), "me_id": f"CASE WHEN {flag(41, 9)} THEN NULL ELSE {count(43, 6)} END"})}, q AS (SELECT *, {_LANE} AS lane, {_ACTION} AS action,
 round(duration_sec + confidence * 10 + CASE WHEN {_ERR} THEN 100 WHEN verdict = 'needs_stronger_audio_judge' THEN 70 ELSE 0 END + CASE WHEN label IN ('remote_duplicate', 'asr_noise') THEN 12 WHEN label IN ('remote_leak', 'lost_me', 'uncertain') THEN 8 ELSE 0 END, 3) AS priority FROM x)"""
_ORDER = "CASE lane " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(dc.LANES)) + " END"


@register("quota_topk", f"""{_QUEUE}, r AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY priority DESC, id) AS k FROM q), u AS (SELECT *, CASE WHEN k <= 2 AND lane NOT IN ('confirm_benign', 'classify_audio') THEN 0 ELSE 1 END AS rest FROM r),
s AS (SELECT * FROM u ORDER BY rest, priority DESC, id LIMIT 40) SELECT id, lane AS review_lane, row_number() OVER (ORDER BY {_ORDER}, priority DESC, id) AS place FROM s""")
def quota_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of each reserved lane, then the best of all, in lane order: a queue of 40."""
    return rv.review_queue(_queue(spark, sf_dir), "review_lane", dc.LANES, dc.RESERVED, 2, 40, [F.desc("priority"), F.col("id")]).select("id", "review_lane", "place")


@register("lane_rollup", f"""{_QUEUE} SELECT lane, label, count(*) AS items, round(sum(duration_sec), 3) AS seconds, {_ORDER} AS place FROM q GROUP BY GROUPING SETS ((lane), (lane, label))""")
def lane_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and seconds by lane and by label in it; place is the lane's fixed order."""
    lane, kind = F.col("review_lane"), F.col("label")
    out = _queue(spark, sf_dir).groupingSets([[lane], [lane, kind]], lane, kind).agg(F.count("*").alias("items"), F.round(F.sum("duration_sec"), 3).alias("seconds"))
    return out.select(lane.alias("lane"), "label", "items", "seconds", (F.array_position(F.array(*map(F.lit, dc.LANES)), lane) - 1).cast("int").alias("place"))


_GROUP = """CASE WHEN me_id IS NULL THEN 'own:' || id WHEN lane IN ('check_unique_me_content', 'classify_audio') THEN 'cross_lane_me_audio:' || session || ':' || me_id WHEN lane = 'check_transcript_order' THEN lane || ':' || session || ':' || label || ':' || action || ':' || me_id ELSE 'own:' || id END"""


@register("related_row_join", f"{_QUEUE} SELECT {_GROUP} AS group_key, count(*) AS rows, min(id) AS first_id, max(id) AS last_id FROM q GROUP BY 1")
def related_row_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows about the same turn are one piece of work, across lanes where its audio decides."""
    return _queue(spark, sf_dir).groupBy(rv.group_key().alias("group_key")).agg(F.count("*").alias("rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@register("action_rollup", f"""{_QUEUE}, g AS (SELECT {_GROUP} AS k, count(*) AS n, min({_ORDER}) AS place FROM q GROUP BY 1) SELECT place, count(*) AS actions, CAST(sum(n - 1) AS BIGINT) AS grouped_rows FROM g GROUP BY place""")
def action_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, and rows beyond their first, by the first lane of each group in lane order."""
    place = (F.array_position(F.array(*map(F.lit, dc.LANES)), F.col("review_lane")) - 1).cast("int")
    groups = _queue(spark, sf_dir).groupBy(rv.group_key().alias("k")).agg(F.count("*").alias("n"), F.min(place).alias("place"))
    return groups.groupBy("place").agg(F.count("*").alias("actions"), F.sum(F.col("n") - 1).alias("grouped_rows"))


_ladder(
    "decision_validate",
    {"decision": pick(7, "drop_me", "keep_me", " drop_remote ", "skip", "todo", "maybe", None), "source": pick(11, "audio", "local_recall", "transcript_order", "audio"), "allowed": f"CASE (event_id * 13) % 9973 % 3 WHEN 0 THEN ARR('drop_me') WHEN 1 THEN ARR('keep_me', 'skip') END"},
    """CASE WHEN source = 'transcript_order' AND coalesce(trim(decision), '') IN ('drop_me', 'drop_remote') THEN trim(decision) || '_is_not_supported_for_transcript_order' WHEN source = 'local_recall' AND trim(decision) = 'keep_me' THEN 'keep_me_requires_materialized_local_recall_utterance'
 WHEN source = 'local_recall' AND coalesce(trim(decision), '') IN ('drop_me', 'drop_remote') THEN trim(decision) || '_is_not_supported_for_local_recall' WHEN coalesce(trim(decision), '') NOT IN ('', 'todo') AND allowed IS NOT NULL AND NOT list_contains(allowed, coalesce(trim(decision), '')) THEN 'decision_not_allowed_for_row'
 WHEN coalesce(trim(decision), '') NOT IN ('drop_me', 'drop_remote', 'keep_me', 'needs_review', 'skip', 'todo', '') THEN 'unknown_decision' END AS invalid_reason""",
    dc.validate_decisions,
    "invalid_reason",
)
_ladder(
    "order_blocking",
    {"role_mismatch": flag(7, 5), "ambiguous": flag(11, 4), "plausible": count(13, 6), "margin": share(17), "content": count(19, 8)},
    "CASE WHEN role_mismatch THEN TRUE WHEN ambiguous THEN FALSE ELSE NOT (plausible >= 3 AND (margin <= 0.2 OR content <= 3)) END AS blocking",
    dc.order_blocking,
    "blocking",
)
_ladder(
    "order_risk_classify",
    {"me_start": "(" + count(7, 40) + ") / 10e0", "me_end": "(" + count(7, 40) + ") / 10e0 + (" + count(11, 120) + ") / 10e0", "remote_start": "(" + count(13, 60) + ") / 10e0", "remote_end": "(" + count(13, 60) + ") / 10e0 + (" + count(17, 60) + ") / 10e0", "similarity": share(19) + " * 0.8", "overlap_type": pick(23, *["double_talk"] * 14, "probable_duplicate_unresolved")},
    """CASE WHEN similarity >= 0.7 OR overlap_type = 'probable_duplicate_unresolved' THEN 'probable_duplicate' WHEN o < 0.5 THEN 'short_overlap' WHEN me_end - me_start >= 6 AND me_start < remote_start AND me_end > remote_end AND remote_end - remote_start >= 0.8 AND me_end - remote_end >= 0.8 THEN 'probable_order_risk'
 WHEN me_end - me_start >= 6 AND o >= 2 THEN 'needs_review' WHEN o <= 2 THEN 'likely_timing_overlap' ELSE 'possible_double_talk' END AS order_label,
 1e0 * CASE WHEN similarity >= 0.7 OR overlap_type = 'probable_duplicate_unresolved' THEN 0.82 WHEN o < 0.5 THEN 0.72 WHEN me_end - me_start >= 6 AND me_start < remote_start AND me_end > remote_end AND remote_end - remote_start >= 0.8 AND me_end - remote_end >= 0.8 THEN CASE WHEN remote_start >= me_start + 0.2 AND remote_end <= me_end - 0.2 THEN 0.86 ELSE 0.78 END
 WHEN me_end - me_start >= 6 AND o >= 2 THEN 0.68 WHEN o <= 2 THEN 0.74 ELSE 0.64 END AS order_confidence""".replace(" o ", " greatest(least(me_end, remote_end) - greatest(me_start, remote_start), 0) "),
    dc.order_risk,
    "order_label",
    "order_confidence",
)
_LIVE = {"prev_start": "1e0 * (" + count(7, 60) + ")", "prev_end": "1e0 * (" + count(7, 60) + ") + (" + count(11, 50) + ") / 10e0", "cur_start": "1e0 * (" + count(7, 60) + ") + (" + count(13, 80) + ") / 10e0 - 1", "cur_end": "1e0 * (" + count(7, 60) + ") + (" + count(13, 80) + ") / 10e0 + 2",
    "prev_batch_start": "1e0 * (" + count(7, 60) + ") + (" + count(17, 3) + ") * (" + count(19, 90) + ")", "cur_batch_start": "1e0 * (" + count(7, 60) + ") + (" + count(23, 5) + ")", "prev_margin": share(29), "cur_margin": share(31), "prev_plausible": count(37, 7), "cur_plausible": count(41, 3),
    "prev_inside": "NOT (" + flag(43, 3) + ")", "cur_inside": "NOT (" + flag(47, 4) + ")", "prev_source": pick(53, "mic", "remote", "separated_mic"), "cur_source": pick(59, "mic", "remote"), "prev_role_ok": "NOT (" + flag(61, 9) + ")", "cur_role_ok": "NOT (" + flag(67, 9) + ")", "ambiguous": flag(71, 3), "batch_delta": "1 - 1e0 * (" + count(73, 6) + ")", "legacy_advisory": flag(79, 3)}
_RISKS = """CASE WHEN NOT (prev_role_ok AND cur_role_ok) THEN 'real_role_conflict' WHEN cur_start < prev_start THEN 'real_timeline_conflict'
 WHEN err >= 120 AND pl >= 5 AND (ambiguous OR mg <= 0.25 OR outside) THEN 'matcher_temporal_false_positive' WHEN prev_end - cur_start >= 0.2 THEN CASE WHEN prev_source <> cur_source THEN 'causal_cross_source_overlap' ELSE 'causal_same_source_overlap_context' END
 WHEN prev_source <> cur_source AND prev_source = 'separated_mic' AND err >= 10 AND (mg <= 0.25 OR pl >= 5 OR outside) THEN 'matcher_temporal_false_positive'
 WHEN cur_start - prev_end > 1 AND batch_delta < -1 AND NOT ambiguous AND mg >= 0.25 AND pl <= 2 AND err <= 5 THEN 'real_timeline_conflict' WHEN cur_start - prev_end <= 1 AND ambiguous AND mg <= 0.2 AND pl >= 2 AND outside THEN 'matcher_ambiguous_reference'
 WHEN legacy_advisory AND (ambiguous OR mg <= 0.25 OR pl >= 5) THEN 'matcher_ambiguous_reference' ELSE 'unresolved' END"""


@register("order_risk_runtime", f"""WITH {evidence_sql(_LIVE)}, y AS (SELECT *, greatest(abs(prev_batch_start - prev_start), abs(cur_batch_start - cur_start)) AS err, greatest(prev_plausible, cur_plausible) AS pl, least(prev_margin, cur_margin) AS mg, NOT prev_inside OR NOT cur_inside AS outside FROM x), z AS (SELECT id, {_RISKS} AS risk FROM y)
SELECT id, risk, CASE WHEN risk IN ('real_role_conflict', 'real_timeline_conflict', 'unresolved') THEN 'blocking' ELSE 'advisory' END AS disposition FROM z""")
def order_risk_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.order_risk_runtime(evidence(spark, sf_dir, _LIVE)).select("id", "risk", "disposition")


_CHRON = {"identity_ok": f"CASE WHEN {flag(7, 11)} THEN NULL ELSE NOT ({flag(11, 13)}) END", "group_label": pick(13, "probable_timing_overlap", "probable_double_talk", "needs_human_review", "probable_timing_overlap", "probable_remote_leak", "probable_double_talk", "other"), "group_confidence": share(17), "judge_label": pick(19, "confirm_me", "confirm_timing_or_doubletalk", "", None), "judge_confidence": share(23),
    "local_evidence": "100 * " + share(29), "audio_leak": "100 * " + share(31), "clean_rms": "-70 + 40 * " + share(37), "remote_rms": "-80 + 50 * " + share(41), "remote_only": share(43) + " * 0.4", "double_talk": share(47) + " * 0.2", "near_boundary": flag(53, 2), "similarity": share(59), "order_label": pick(61, "probable_order_risk", "needs_review"), "wraps": flag(67, 2), "tail_sec": share(71) + " * 2", "order_confidence": share(73)}


@register("chronology_arbitrate", f"""WITH {evidence_sql(_CHRON)}, a AS (SELECT *, local_evidence >= 60 AND clean_rms >= -52 AND audio_leak < 90 AS loc, remote_rms >= -48 OR remote_only >= 0.2 OR double_talk >= 0.1 AS act, coalesce(judge_label IN ('confirm_me', 'confirm_timing_or_doubletalk'), FALSE) AND judge_confidence >= 0.78 AS jud FROM x),
b AS (SELECT *, group_label = 'probable_timing_overlap' AND group_confidence >= 0.75 AND near_boundary AND similarity < 0.55 AND audio_leak < 70 AND loc AS tim, group_label = 'probable_double_talk' AND group_confidence >= 0.7 AND loc AND act AS dt, jud AND loc AND (remote_rms < -48 OR double_talk >= 0.1 OR group_label IN ('probable_timing_overlap', 'probable_double_talk')) AS con FROM a),
c AS (SELECT *, CASE WHEN identity_ok IS NOT TRUE THEN 'insufficient_evidence' WHEN group_label = 'probable_remote_leak' THEN 'remote_leak_or_asr_segmentation' WHEN dt OR (con AND act) THEN 'confirmed_double_talk' WHEN tim OR con THEN 'benign_turn_boundary' WHEN order_label = 'probable_order_risk' AND wraps AND tail_sec >= 0.8 THEN 'true_chronology_risk' ELSE 'insufficient_evidence' END AS chronology FROM b)
SELECT id, chronology, CASE WHEN identity_ok IS NOT TRUE THEN 0 WHEN chronology = 'remote_leak_or_asr_segmentation' THEN group_confidence WHEN chronology = 'confirmed_double_talk' THEN greatest(CASE WHEN dt THEN group_confidence ELSE 0 END, judge_confidence) WHEN chronology = 'benign_turn_boundary' THEN CASE WHEN tim AND NOT jud THEN group_confidence ELSE greatest(CASE WHEN tim THEN group_confidence ELSE 0 END, judge_confidence) END
 WHEN chronology = 'true_chronology_risk' THEN order_confidence ELSE greatest(group_confidence, judge_confidence) END AS chronology_confidence FROM c""")
def chronology_arbitrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.chronology(evidence(spark, sf_dir, _CHRON)).select("id", "chronology", "chronology_confidence")


_ladder(
    "integrity_classify",
    {"deterministic_safe": flag(7, 9), "judge_status": pick(11, "ok", "ok", "ok", "failed", None), "judge_reason": pick(13, "timeout", None), "kind": pick(17, "decoder_repetition_loop", "internal_exact_repeat", "adjacent_exact_repeat", "other"), "exact_count": count(19, 3), "fuzzy_support": share(23), "repaired_similarity": share(29), "original_similarity": share(31) + " * 0.7", "repeat_count": count(37, 9), "rms_db": "-80 + 40 * " + share(41)},
    """CASE WHEN deterministic_safe OR (judge_status IS NOT DISTINCT FROM 'ok' AND (kind = 'decoder_repetition_loop' AND repeat_count >= 4 AND exact_count = 0 AND fuzzy_support < 0.55 AND rms_db <= -55 OR kind = 'internal_exact_repeat' AND exact_count <= 1 AND fuzzy_support >= 0.72 AND repaired_similarity >= 0.48 AND repaired_similarity - original_similarity >= 0.04 OR kind = 'adjacent_exact_repeat' AND exact_count = 1 AND fuzzy_support >= 0.8)) THEN 'apply' ELSE 'needs_review' END AS outcome,
 CASE WHEN deterministic_safe THEN 1 WHEN judge_status IS DISTINCT FROM 'ok' THEN 0 WHEN kind = 'decoder_repetition_loop' THEN CASE WHEN repeat_count >= 4 AND exact_count = 0 AND fuzzy_support < 0.55 AND rms_db <= -55 THEN 0.99 ELSE 0.5 END
 WHEN kind = 'internal_exact_repeat' THEN CASE WHEN exact_count <= 1 AND fuzzy_support >= 0.72 AND repaired_similarity >= 0.48 AND repaired_similarity - original_similarity >= 0.04 THEN round(least(0.99, 0.82 + greatest(0, repaired_similarity - original_similarity)), 6) ELSE 0.5 END
 WHEN kind = 'adjacent_exact_repeat' THEN CASE WHEN exact_count = 1 AND fuzzy_support >= 0.8 THEN 0.9 ELSE 0.5 END ELSE 0 END AS outcome_confidence""",
    dc.integrity,
    "outcome",
    "outcome_confidence",
)
_ladder(
    "prefilter_route",
    {"contract_ok": "NOT (" + flag(7, 6) + ")", "seeds": count(11, 3), "target_margin": f"CASE WHEN {flag(13, 4)} THEN NULL ELSE {share(17)} * 0.4 END", "remote_similarity": f"CASE WHEN {flag(19, 5)} THEN NULL ELSE {share(23)} END", "remote_recall": share(29)},
    "CASE WHEN contract_ok AND seeds > 0 AND target_margin >= 0.15 THEN 'expensive_candidate' WHEN contract_ok AND remote_similarity >= 0.88 AND remote_recall >= 0.65 THEN 'cheap_reject' ELSE 'unresolved' END AS route",
    dc.prefilter,
    "route",
)
_GATES = {
    "label": pick(7, "probable_duplicate", "probable_asr_noise", "remote_duplicate", "asr_noise"), "verdict": pick(11, "probable_transcript_error", "probable_transcript_error", "other"), "judge_label": pick(13, "drop_error", "drop_error", "drop_error", "mark_only_error", "keep"), "confidence": "0.8 + 0.2 * " + share(17), "judge_confidence": "0.9 + 0.1 * " + share(19), "text_duplicate": "60 + 40 * " + share(23), "similarity": "0.5 + 0.5 * " + share(29), "containment": "0.5 + 0.5 * " + share(31),
    "coverage": "0.3 + 0.7 * " + share(37), "local_evidence": "70 * " + share(41), "local_only": share(43) + " * 0.5", "double_talk": share(47), "local_score_max": share(53) + " * 0.8", "unique_tokens": count(59, 5), "has_marker": flag(61, 4), "notes_impact": flag(67, 4), "starts_with_agreement": flag(71, 6), "near_boundary": flag(73, 3), "me_start": "10 + 5 * " + share(79), "remote_end": "10e0", "duration_sec": "4 * " + share(83),
    "content_tokens": count(89, 6), "domain_terms": count(97, 2), "duplicate_score": "60 + 40 * " + share(101), "noise_score": "60 + 40 * " + share(103), "review_safe": flag(107, 9),
}
_KEPT = "(has_marker AND NOT (confidence >= 0.95 AND (unique_tokens = 0 OR (unique_tokens <= 2 AND NOT notes_impact))) OR unique_tokens >= 3 AND (starts_with_agreement OR ((local_evidence >= 45 OR local_score_max >= 0.65 OR local_only >= 0.25) AND (me_start - remote_end BETWEEN -0.2 AND 2.5 OR near_boundary))))"
_ladder(
    "audit_duplicate_gate",
    _GATES,
    f"""label = 'probable_duplicate' AND confidence >= 0.88 AND (text_duplicate >= 85 OR (similarity >= 0.78 AND containment >= 0.75)) AND ((local_evidence <= 45 AND local_only < 0.7 AND double_talk < 0.75) OR (confidence >= 0.95 AND text_duplicate >= 95 AND unique_tokens <= 2))
 AND (coverage >= 0.8 OR (confidence >= 0.95 AND text_duplicate >= 95 AND coverage >= 0.5)) AND unique_tokens <= 2 AND NOT {_KEPT} AND (NOT notes_impact OR (confidence >= 0.95 AND unique_tokens = 0)) AS safe""",
    lambda x: x.withColumn("safe", dc.duplicate_gate()),
    "safe",
)
_ladder(
    "audit_noise_gate",
    _GATES,
    "label = 'probable_asr_noise' AND confidence >= 0.85 AND duration_sec <= 2.5 AND content_tokens <= 3 AND domain_terms = 0 AND NOT has_marker AND local_evidence <= 25 AND local_only < 0.2 AS safe",
    lambda x: x.withColumn("safe", dc.noise_gate()),
    "safe",
)
_COMMON = f"verdict = 'probable_transcript_error' AND judge_label = 'drop_error' AND judge_confidence >= 0.98 AND NOT {_KEPT} AND (NOT notes_impact OR (judge_confidence >= 0.995 AND unique_tokens = 0))"
_ladder(
    "audit_judge_gate",
    _GATES,
    f"""judge_label <> 'mark_only_error' AND (review_safe OR (label = 'remote_duplicate' AND {_COMMON} AND duplicate_score >= 75 AND local_evidence <= 60 AND (similarity >= 0.6 OR containment >= 0.65 OR duplicate_score >= 90) AND coverage >= 0.45 AND unique_tokens <= 2)
 OR (label = 'asr_noise' AND {_COMMON} AND noise_score >= 75 AND local_evidence <= 45 AND duration_sec <= 2.5 AND content_tokens <= 3 AND domain_terms = 0 AND NOT has_marker)
 OR (label = 'remote_duplicate' AND verdict = 'probable_transcript_error' AND judge_label = 'drop_error' AND judge_confidence >= 0.93 AND NOT {_KEPT} AND NOT notes_impact AND duplicate_score >= 82 AND local_evidence <= 55 AND similarity >= 0.75 AND containment >= 0.75 AND coverage >= 0.6 AND unique_tokens <= 2)) AS safe""",
    lambda x: x.withColumn("safe", dc.judge_gate()),
    "safe",
)
_RECALL = {"duration_sec": "2 * " + share(7), "content_tokens": count(11, 6), "mic_db": "-70 + 30 * " + share(13), "local_only": share(17), "double_talk": share(19) + " * 0.4", "remote_active": share(23), "remote_coverage": share(29), "has_marker": flag(31, 4), "boundary_fragment": flag(37, 5), "acknowledgement": flag(41, 4), "session": count(43, 25)}
_RECALL_CASE = """CASE WHEN duration_sec < 0.55 THEN 'likely_harmless_short' WHEN content_tokens >= 3 AND remote_coverage >= 0.7 THEN 'likely_harmless_remote_covered' WHEN boundary_fragment AND content_tokens >= 3 AND remote_coverage >= 0.5 THEN 'likely_harmless_remote_boundary_covered' WHEN acknowledgement AND NOT has_marker AND duration_sec <= 1.6 THEN 'likely_harmless_ack_fragment'
 WHEN boundary_fragment AND NOT has_marker THEN 'likely_harmless_boundary_fragment' WHEN local_only >= 0.55 AND mic_db > -52 AND duration_sec >= 1.2 THEN 'possible_lost_me' WHEN local_only + double_talk >= 0.55 AND duration_sec >= 0.9 AND mic_db > -55 THEN 'needs_review' WHEN has_marker AND duration_sec >= 0.8 AND mic_db > -58 THEN 'needs_review'
 WHEN remote_active >= 0.65 AND local_only < 0.25 THEN 'likely_harmless_remote_guard' WHEN mic_db <= -55 THEN 'likely_harmless_weak_audio' ELSE 'needs_review' END"""
_ladder("local_recall_classify", _RECALL, f"{_RECALL_CASE} AS recall_label", dc.local_recall, "recall_label")


@register("local_recall_summary", f"""WITH {evidence_sql(_RECALL)}, l AS (SELECT *, {_RECALL_CASE} AS k FROM x), s AS (SELECT session, count(*) AS items, count_if(k = 'possible_lost_me') AS lost, coalesce(sum(duration_sec) FILTER (k = 'possible_lost_me'), 0) AS lost_sec, coalesce(sum(duration_sec) FILTER (k = 'needs_review'), 0) AS review_sec, coalesce(sum(duration_sec) FILTER (k LIKE 'likely_harmless%'), 0) AS harmless_sec FROM l GROUP BY session)
SELECT *, lost > 0 OR lost_sec + review_sec >= 5 AS blocking, CASE WHEN lost > 0 OR lost_sec + review_sec >= 5 THEN 'review_local_recall_items' ELSE 'local_recall_risk_explained' END AS next_step FROM s""")
def local_recall_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.recall_summary(dc.local_recall(evidence(spark, sf_dir, _RECALL)), "session")


_ladder(
    "verdict",
    {"fatal_risk": flag(7, 17), "utterances": count(11, 9), "verified_no_speech": flag(13, 2), "audited": "NOT (" + flag(17, 3) + ")", "duration_sec": "600e0 * (" + count(19, 8) + ")", "harmful_sec": "120 * " + share(23) + " * " + share(29), "review_sec": "500 * " + share(31) + " * " + share(37), "local_recall": "0.75 + 0.25 * " + share(41), "recall_explained": flag(43, 2), "needs_review": count(47, 3), "long_overlaps": count(53, 3),
        "partial_scope": flag(59, 7), "high_risk": flag(61, 9), "shadow_unproven": flag(67, 11), "long_crossings": "CASE WHEN " + flag(71, 8) + " THEN 1 ELSE 0 END", "golden_failures": "0", "needs_ratio": share(73) + " * 0.15", "duplicate_sec": "190 * " + share(79) + " * (" + count(83, 2) + ")", "medium_risk": flag(89, 5)},
    """CASE WHEN fatal_risk THEN 'failed' WHEN utterances = 0 THEN CASE WHEN verified_no_speech THEN 'good' ELSE 'failed' END
 WHEN audited THEN CASE WHEN (local_recall < 0.7 AND NOT recall_explained) OR harmful_sec > greatest(180, greatest(1, duration_sec) * 0.06) OR review_sec > greatest(900, greatest(1, duration_sec) * 0.35) THEN 'failed'
  WHEN (local_recall < 0.8 AND NOT recall_explained) OR harmful_sec > greatest(90, greatest(1, duration_sec) * 0.03) OR review_sec > greatest(300, greatest(1, duration_sec) * 0.12) THEN 'risky'
  WHEN partial_scope OR harmful_sec > greatest(30, greatest(1, duration_sec) * 0.01) OR review_sec > greatest(60, greatest(1, duration_sec) * 0.03) OR needs_review > 0 OR long_overlaps > 0 THEN 'usable_with_review' ELSE 'good' END
 WHEN high_risk OR shadow_unproven OR long_crossings > 0 OR needs_ratio > 0.12 OR duplicate_sec > 180 THEN 'risky' WHEN medium_risk OR needs_review > 0 OR long_overlaps > 0 OR duplicate_sec > 0 THEN 'usable_with_review' ELSE 'good' END AS session_verdict""",
    dc.verdict,
    "session_verdict",
)
_OVER = {"local_score": share(7), "local_only": share(11), "double_talk": share(13), "remote_only": share(17), "remote_active": share(19), "silence": share(23) + " * 0.5", "clean_rms": "-60 + 30 * " + share(29), "masked_rms": "-65 + 20 * " + share(31), "clean_corr": share(37) + " * 0.3", "raw_corr": share(41) + " * 0.5", "lag_consistent": flag(43, 2), "mel_cosine": share(47), "coherence": share(53) + " * 0.7", "energy_drop_db": "-24 * " + share(59),
    "similarity": share(61), "containment": share(67), "term_overlap": share(71), "time_overlap": share(73), "me_tokens": count(79, 9), "near_boundary": flag(83, 2), "backchannel": flag(89, 3), "duration_sec": "12 * " + share(97)}
_OVER_SQL = f"""WITH {evidence_sql(_OVER)}, a AS (SELECT *, greatest(0, least(100, CASE WHEN local_score >= 0.65 THEN 35 ELSE 0 END + CASE WHEN local_only >= 0.5 THEN 25 ELSE 0 END + CASE WHEN double_talk >= 0.4 THEN 20 ELSE 0 END + CASE WHEN clean_rms > -45 AND clean_corr < 0.16 THEN 15 ELSE 0 END + CASE WHEN backchannel AND similarity < 0.6 THEN 10 ELSE 0 END - CASE WHEN remote_only >= 0.6 THEN 25 ELSE 0 END - CASE WHEN masked_rms <= -55 THEN 20 ELSE 0 END)) AS l,
 greatest(0, least(100, CASE WHEN raw_corr >= 0.25 THEN 30 ELSE 0 END + CASE WHEN lag_consistent THEN 20 ELSE 0 END + CASE WHEN mel_cosine >= 0.72 THEN 20 ELSE 0 END + CASE WHEN coherence >= 0.35 THEN 15 ELSE 0 END + CASE WHEN energy_drop_db <= -12 THEN 15 ELSE 0 END - CASE WHEN clean_rms > -42 AND clean_corr < 0.16 THEN 25 ELSE 0 END)) AS k,
 greatest(0, least(100, CASE WHEN similarity >= 0.75 THEN 35 ELSE 0 END + CASE WHEN containment >= 0.8 THEN 25 ELSE 0 END + CASE WHEN term_overlap >= 0.6 THEN 20 ELSE 0 END + CASE WHEN time_overlap >= 0.5 THEN 15 ELSE 0 END - CASE WHEN backchannel AND similarity < 0.6 THEN 20 ELSE 0 END)) AS t FROM x),
b AS (SELECT *, greatest(0, least(100, CASE WHEN remote_active >= 0.7 THEN 30 ELSE 0 END + CASE WHEN remote_only >= 0.5 THEN 25 ELSE 0 END + CASE WHEN k >= 70 THEN 20 ELSE 0 END + CASE WHEN lag_consistent THEN 15 ELSE 0 END + CASE WHEN similarity >= 0.75 THEN 15 ELSE 0 END - CASE WHEN l >= 65 THEN 25 ELSE 0 END)) AS r FROM a),
c AS (SELECT id, duration_sec, 1e0 * least(100, greatest(CASE WHEN t >= 70 AND l < 55 THEN t + 5 ELSE 0 END, CASE WHEN similarity >= 0.65 AND remote_only >= 0.5 AND local_score < 0.4 THEN 78 ELSE 0 END)) AS probable_duplicate, 1e0 * CASE WHEN k >= 70 AND l < 50 AND r >= 60 THEN k WHEN k >= 60 AND remote_only >= 0.5 AND l < 45 THEN 68 ELSE 0 END AS probable_remote_leak,
 1e0 * least(100, greatest(CASE WHEN l >= 65 AND remote_active >= 0.5 AND similarity < 0.6 THEN l + 5 ELSE 0 END, CASE WHEN double_talk >= 0.4 AND clean_rms > -50 AND k < 70 AND similarity < 0.6 THEN 75 ELSE 0 END)) AS probable_double_talk, 1e0 * CASE WHEN similarity < 0.45 AND k < 55 AND l >= 45 AND near_boundary THEN 75 WHEN near_boundary AND time_overlap < 0.25 AND similarity < 0.55 THEN 68 ELSE 0 END AS probable_timing_overlap,
 1e0 * CASE WHEN backchannel AND l < 45 AND masked_rms <= -55 THEN 78 WHEN me_tokens <= 2 AND silence + remote_only >= 0.6 AND l < 45 THEN 70 ELSE 0 END AS probable_asr_noise FROM b)"""


@register("overlap_scores", _OVER_SQL + " SELECT id, probable_duplicate, probable_remote_leak, probable_double_talk, probable_timing_overlap, probable_asr_noise FROM c")
def overlap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.overlap_scores(evidence(spark, sf_dir, _OVER)).select("id", *dc.CATEGORIES)


@register("overlap_classify", _OVER_SQL + """, u AS (SELECT id, duration_sec, unnest([{'s': probable_duplicate, 'o': 5, 'k': 'probable_duplicate'}, {'s': probable_remote_leak, 'o': 4, 'k': 'probable_remote_leak'}, {'s': probable_double_talk, 'o': 3, 'k': 'probable_double_talk'}, {'s': probable_timing_overlap, 'o': 2, 'k': 'probable_timing_overlap'}, {'s': probable_asr_noise, 'o': 1, 'k': 'probable_asr_noise'}]) AS x FROM c),
r AS (SELECT *, row_number() OVER w AS r, lead(x.s) OVER w AS second FROM u WINDOW w AS (PARTITION BY id ORDER BY x.s DESC, x.o DESC))
SELECT id, CASE WHEN x.s < 70 OR x.s - second < 12 OR (duration_sec > 8 AND x.s < 82) THEN 'needs_human_review' ELSE x.k END AS overlap_label, round(CASE WHEN x.s < 70 OR x.s - second < 12 OR (duration_sec > 8 AND x.s < 82) THEN least(0.69, x.s / 100) ELSE least(0.99, greatest(0.7, x.s / 100)) END, 3) AS overlap_confidence FROM r WHERE r = 1""")
def overlap_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.overlap_label(dc.overlap_scores(evidence(spark, sf_dir, _OVER))).select("id", "overlap_label", "overlap_confidence")


_MODE = {"session": count(7, 60), "state": pick(11, "remote_only", "double_talk", "remote_only", "silence"), "similarity": f"CASE WHEN {flag(13, 9)} THEN NULL ELSE 0.13 * {share(17)} * ({count(7, 60)}) / 60 END"}


@register("acoustic_mode", f"""WITH {evidence_sql(_MODE)}, r AS (SELECT session, coalesce(similarity, 0) AS v, row_number() OVER (PARTITION BY session ORDER BY coalesce(similarity, 0)) - 1 AS i, count(*) OVER (PARTITION BY session) AS n FROM x WHERE state = 'remote_only'),
s AS (SELECT session, any_value(n) AS n, count_if(v >= 0.04) / CAST(any_value(n) AS DOUBLE) AS q, max(v) FILTER (i = least(n - 1, floor(n * 0.75))) AS a, max(v) FILTER (i = least(n - 1, floor(n * 0.9))) AS b FROM r GROUP BY session), t AS (SELECT DISTINCT session FROM x)
SELECT session, CASE WHEN coalesce(n, 0) < 5 THEN 'uncertain' WHEN q >= 0.3 AND a >= 0.04 THEN 'speaker_playback' WHEN q <= 0.15 AND a <= 0.03 AND b <= 0.06 THEN 'headphones_or_low_leak' ELSE 'uncertain' END AS mode,
 1e0 * CASE WHEN coalesce(n, 0) < 5 THEN 0 WHEN q >= 0.3 AND a >= 0.04 THEN CASE WHEN q >= 0.5 AND a >= 0.08 THEN 0.9 ELSE 0.75 END WHEN q <= 0.15 AND a <= 0.03 AND b <= 0.06 THEN CASE WHEN q <= 0.1 AND a <= 0.02 THEN 0.9 ELSE 0.75 END ELSE 0.5 END AS mode_confidence FROM t LEFT JOIN s USING (session)""")
def acoustic_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.acoustic_mode(evidence(spark, sf_dir, _MODE), "session")


_ladder(
    "target_voice_classify",
    {"enrolled": "NOT (" + flag(7, 12) + ")", "target_threshold": "0.45e0", "weak_threshold": "0.38e0", "best_mic": share(11) + " * 0.8", "remote_similarity": share(13) + " * 0.7", "remote_active": share(17), "local_score": share(19) + " * 0.5", "local_only": share(23) + " * 0.6", "double_talk": share(29) + " * 0.3", "audio_verdict": pick(31, "probable_transcript_error", "other"), "audio_label": pick(37, "remote_duplicate", "double_talk", "uncertain"), "judge_label": pick(41, "", "confirm_me", "confirm_asr_noise"), "me_tokens": count(43, 14)},
    """CASE WHEN NOT enrolled THEN 'target_me_ambiguous' WHEN best_mic >= 0.45 AND best_mic - remote_similarity >= 0.08 THEN 'target_me_confirmed' WHEN best_mic >= 0.38 AND (local_score >= 0.25 OR double_talk >= 0.2 OR judge_label = 'confirm_me') THEN 'target_me_possible'
 WHEN best_mic < 0.38 AND remote_active >= 0.45 AND (audio_verdict = 'probable_transcript_error' AND audio_label IN ('remote_duplicate', 'uncertain') OR judge_label = 'confirm_asr_noise') THEN 'target_me_absent_remote_like' WHEN best_mic < 0.38 AND local_only < 0.2 AND remote_active >= 0.35 THEN 'target_me_absent' ELSE 'target_me_ambiguous' END AS voice_label,
 CASE WHEN NOT enrolled THEN 'needs_review' WHEN best_mic >= 0.45 AND best_mic - remote_similarity >= 0.08 THEN 'keep_me' WHEN best_mic >= 0.38 THEN 'needs_review' WHEN remote_active >= 0.45 AND (audio_verdict = 'probable_transcript_error' AND audio_label IN ('remote_duplicate', 'uncertain') OR judge_label = 'confirm_asr_noise') AND me_tokens < 8 THEN 'drop_me_evidence_only' ELSE 'needs_review' END AS voice_decision""",
    dc.target_voice,
    "voice_label",
    "voice_decision",
)
_ROLE = {"track": pick(7, "mic", "mic", "mic", "mic", "remote"), "repair_action": pick(11, *[""] * 9, "split", "drop", "keep_needs_review"), "repair_reason": pick(13, None, "island"), "repair_needs_review": flag(17, 3), "weak_phrase": flag(19, 6), "isolated": flag(23, 3), "time_overlap": share(29), "similarity": share(31), "term_overlap": share(37), "matched": "NOT (" + flag(41, 4) + ")", "remote_active": share(43), "local_only": share(47) + " * 0.9", "double_talk": share(53) + " * 0.5", "local_score": share(59) + " * 0.6", "local_support_sec": share(61), "no_speech": f"CASE WHEN {flag(67, 3)} THEN NULL ELSE {share(71)} END", "duration_sec": "10 * " + share(73)}


@register("role_decision", f"""WITH {evidence_sql(_ROLE)}, d AS (SELECT *, greatest(0, least(1, round(CASE WHEN time_overlap > 0.5 THEN 0.25 ELSE 0 END + CASE WHEN similarity > 0.7 THEN 0.35 WHEN similarity > 0.55 AND term_overlap > 0.4 THEN 0.25 ELSE 0 END + CASE WHEN remote_active > 0.7 THEN 0.15 ELSE 0 END + CASE WHEN local_score < 0.25 THEN 0.2 ELSE 0 END + CASE WHEN no_speech > 0.6 THEN 0.1 ELSE 0 END - CASE WHEN double_talk > 0.3 THEN 0.2 ELSE 0 END - CASE WHEN local_only > 0.6 THEN 0.4 ELSE 0 END, 6))) AS p FROM x),
e AS (SELECT *, CASE WHEN track = 'mic' AND repair_action <> '' THEN coalesce(repair_reason, 'timeline_repair_local_island') WHEN weak_phrase AND isolated THEN 'weak_isolated_hallucination' WHEN track = 'remote' THEN 'authoritative_remote' WHEN local_only > 0.8 THEN 'strong_local_only'
 WHEN matched AND remote_active > 0.7 AND local_score < 0.3 AND time_overlap > 0.7 AND (duration_sec < 4 OR similarity > 0.45 OR local_support_sec < 0.5) THEN 'remote_leak_echo_overlap' WHEN matched AND remote_active > 0.7 AND local_score < 0.3 AND local_support_sec >= 0.5 AND similarity <= 0.45 THEN 'local_support_inside_remote_active'
 WHEN matched AND time_overlap > 0.7 AND local_score < 0.2 THEN 'remote_leak_time_overlap' WHEN remote_active >= 0.95 AND local_score <= 0.05 THEN 'echo_guard_remote_active' WHEN p >= 0.7 THEN 'remote_duplicate' WHEN p >= 0.55 AND (similarity > 0.45 OR time_overlap > 0.5) THEN 'probable_remote_duplicate' WHEN p >= 0.45 THEN 'uncertain_overlap' ELSE 'mic_local_candidate' END AS role_reason FROM d)
SELECT id, role_reason, CASE WHEN track = 'mic' AND repair_action <> '' THEN repair_action WHEN role_reason IN ('authoritative_remote', 'strong_local_only', 'mic_local_candidate') THEN 'keep' WHEN role_reason IN ('local_support_inside_remote_active', 'uncertain_overlap') THEN 'keep_needs_review' ELSE 'drop' END AS role_action FROM e""")
def role_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.role_decision(evidence(spark, sf_dir, _ROLE)).select("id", "role_reason", "role_action")


_UNITS = {"role": pick(7, "remote", "me", "remote"), "start": "1e0 * (" + count(11, 50) + ")", "end": f"CASE WHEN {flag(13, 15)} THEN NULL ELSE 1e0 * ({count(11, 50)}) + ({count(17, 150)}) / 10e0 END", "needs_review": flag(19, 7), "text": pick(23, "hello there", " ", None, "so it is")}


@register("unit_gate", f"""WITH {evidence_sql(_UNITS)} SELECT id, CASE WHEN "end" IS NULL THEN 'invalid_interval' WHEN needs_review THEN 'source_needs_review' WHEN "end" - start < 1 THEN 'too_short_for_voice_evidence' WHEN "end" - start > 12 THEN 'too_long_for_single_speaker_evidence' WHEN coalesce(trim(text), '') = '' THEN 'empty_text' END AS unit_reason FROM x WHERE role = 'remote'""")
def unit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.unit_gate(evidence(spark, sf_dir, _UNITS)).select("id", "unit_reason")


_ladder(
    "needs_attention_filter",
    {"bucket": pick(7, "wrong", "fine", "unsure"), "cv_correct": f"CASE WHEN {flag(11, 3)} THEN NULL ELSE {flag(13, 2)} END", "action": pick(17, "recheck", "none")},
    "bucket IN ('wrong', 'unsure') OR (cv_correct IS NOT NULL AND NOT cv_correct) OR action = 'recheck' AS attention",
    lambda x: x.withColumn("attention", dc.needs_attention(["wrong", "unsure"], ["recheck"])),
    "attention",
)
_ladder(
    "content_class_projection",
    {"key": pick(7, "transcript_json", "notes_md", "verdict", "audio_review", "other", "quality"), "path": pick(11, "a/clean_dialogue.json", "a/Notes.md", "x/quality_report.json", "review/b.bin", "x/plain.json")},
    """CASE WHEN key LIKE '%transcript%' OR path LIKE '%clean_dialogue%' THEN 'transcript_or_dialogue' WHEN key LIKE '%notes%' OR path LIKE '%Notes%' THEN 'meeting_notes' WHEN key IN ('verdict', 'quality') OR path LIKE '%quality%' THEN 'quality_metadata' WHEN key LIKE '%review%' THEN 'review_metadata' WHEN path LIKE '%.json' THEN 'evidence_json' ELSE 'export_file' END AS class""",
    lambda x: x.withColumn("class", dc.content_class(F.col("key"), F.col("path"))),
    "class",
)
