"""Decision ladders over flat evidence columns: each function reads named columns of a table and adds its answer to every row.

The order of conditions decides; thresholds are those of the published policies. A null number counts as 0, a null flag as
false and a null label as '', so every row gets an answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.review import flags, ladder


def num(name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(default))


def yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def label(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def points(*terms: tuple[Column, float]) -> Column:
    """The sum of the points whose conditions hold."""
    out = F.lit(0.0)
    for condition, worth in terms:
        out = out + F.when(condition, F.lit(float(worth))).otherwise(0.0)
    return out


def use_gate(rows: DataFrame) -> DataFrame:
    """use_gate of sessions by pipeline_complete, verdict, cleaned_profile, cleanup_attempted, residual_risk, burden_sec, duration_sec, n_flags."""
    burden = F.when(num("duration_sec") > 0, num("burden_sec") / num("duration_sec")).otherwise(0.0)
    manual = "do_not_use_without_manual_review"
    gate = ladder(
        manual,
        (~yes("pipeline_complete"), "pipeline_incomplete"),
        (label("verdict") == "failed", manual),
        ((label("verdict") == "risky") & ~yes("residual_risk"), manual),
        (~yes("cleaned_profile") & yes("cleanup_attempted"), "review_first"),
        (~yes("cleaned_profile"), "pipeline_incomplete_review_first"),
        (yes("residual_risk"), "review_first"),
        ((burden <= 0.025) & (num("n_flags") == 0), "ready_for_notes"),
        (burden <= 0.08, "review_first"),
    )
    return rows.withColumn("use_gate", gate)


def review_burden(rows: DataFrame) -> DataFrame:
    """notes and transcript burden in seconds and as a ratio: what is left to hear, at least the remaining scope. Notes' own figures come first where there are any."""
    shared = num("recall_review_sec") + num("order_review_sec")
    heard = F.coalesce("notes_error_sec", num("error_sec")) + F.coalesce("notes_judge_sec", num("judge_sec"))
    notes = F.round(F.greatest(heard + shared, num("scope_remaining_sec")), 3)
    transcript = F.round(F.greatest(num("error_sec") + num("judge_sec") + shared, num("scope_remaining_sec")), 3)
    share = [F.when(num("duration_sec") > 0, F.round(x / num("duration_sec"), 6)).otherwise(0.0) for x in (notes, transcript)]
    blockers = flags(("full_transcript_review_required", transcript > notes + 0.001), ("full_transcript_needs_review_required", num("needs_review") > num("notes_needs_review")))
    return rows.select("*", notes.alias("notes_burden_sec"), share[0].alias("notes_burden_ratio"), transcript.alias("transcript_burden_sec"), share[1].alias("transcript_burden_ratio"), blockers.alias("export_reasons"))


def risk_flags(rows: DataFrame) -> DataFrame:
    """risk_flags: names of what is wrong with a session, in the fixed order of the checks."""
    recall, duration, errors, error_sec = F.col("local_recall"), num("duration_sec"), num("notes_error_count"), num("notes_error_sec")
    partial = (F.col("scope_complete") == F.lit(False)) & (num("scope_remaining_sec") > 0.001) & (num("decisions_applied") > 0) & (num("decisions_rejected") == 0) & (num("decisions_conflicts") == 0)
    partial = F.coalesce(partial, F.lit(False))
    gates_failed, low, lost = ~yes("decision_gates_passed") & ~partial, F.coalesce(recall < 0.9, F.lit(False)), yes("recall_blocking")
    profile, verdict = label("profile"), label("verdict")
    named = [
        ("verdict:risky", verdict == "risky"),
        ("verdict:failed", verdict == "failed"),
        ("no_audit_cleanup_profile", ~yes("cleaned_profile")),
        ("review_decisions_gates_failed", (profile == "reviewed_v1") & gates_failed),
        ("partial_review_scope", (profile == "reviewed_v1") & F.coalesce(F.col("scope_complete") == F.lit(False), F.lit(False))),
        ("agent_review_decisions_gates_failed", (profile == "agent_reviewed_v1") & gates_failed),
        ("unrepaired_long_mic_crossings", num("long_crossings") > 0),
        ("golden_phrase_fail", num("golden_failures") > 0),
        ("local_recall_possible_lost_me", lost),
        ("transcript_order_risk", yes("order_blocking")),
        ("low_local_recall", low & (label("recall_audit") != "ok")),
        ("notes_high_needs_review_ratio", F.coalesce(F.col("notes_needs_ratio") > 0.12, F.lit(False))),
        ("high_needs_review_ratio", F.col("notes_needs_ratio").isNull() & (num("needs_ratio") > 0.12)),
        ("high_harmful_overlap_ratio", (duration > 0) & (num("harmful_sec") > 0.03 * duration)),
        ("high_review_overlap_ratio", (duration > 0) & (num("review_sec") > 0.12 * duration)),
        ("notes_audio_review_probable_errors", (errors >= 3) | (error_sec >= 10)),
        ("remote_leak_segment_repair_candidates", (num("leak_protect_items") > 0) & ((errors > 0) | (error_sec > 0))),
        ("stale_remote_leak_segment_plan", num("leak_stale_items") > 0),
        ("notes_need_stronger_audio_judge", (num("notes_judge_count") >= 20) | (num("notes_judge_sec") >= 60)),
    ]
    return rows.withColumn("risk_flags", flags(*named))


def drop_hint_allowed() -> Column:
    return (num("me_coverage") >= 0.80) & ((num("similarity") >= 0.92) | (num("containment") >= 0.75))


def priority(rows: DataFrame) -> DataFrame:
    """priority of review items: length, confidence, verdict and label."""
    kind = F.when(label("verdict") == "probable_transcript_error", 100).when(label("verdict") == "needs_stronger_audio_judge", 70).otherwise(0)
    bonus = F.when(label("label").isin("remote_duplicate", "asr_noise"), 12).when(label("label").isin("remote_leak", "lost_me", "uncertain"), 8).otherwise(0)
    return rows.withColumn("priority", F.round(num("duration_sec") + num("confidence") * 10 + kind + bonus, 3))


# Review lanes in their order.
LANES = ["fast_confirm_drop", "check_unique_me_content", "check_local_recall", "check_transcript_text", "check_transcript_order", "confirm_benign", "classify_audio"]
RESERVED = ["fast_confirm_drop", "check_unique_me_content", "check_local_recall", "check_transcript_order", "check_transcript_text"]


def review_lane(rows: DataFrame) -> DataFrame:
    """review_lane and review_action of items by source, label, verdict and the evidence for a drop."""
    source, kind, error, hint = label("source"), label("label"), label("verdict") == "probable_transcript_error", drop_hint_allowed()
    lane = ladder(
        "classify_audio",
        (source.isin("local_recall", "local_recall_repair") | kind.isin("lost_me", "local_recall_needs_review", "local_recall_repair_inserted"), "check_local_recall"),
        ((source == "transcript_text") | (kind == "transcript_text_needs_review"), "check_transcript_text"),
        ((source == "transcript_order") | (kind == "probable_order_risk"), "check_transcript_order"),
        ((kind == "remote_duplicate") & error & hint, "fast_confirm_drop"),
        ((kind == "remote_duplicate") & error, "check_unique_me_content"),
        ((kind == "asr_noise") & error, "fast_confirm_drop"),
        (kind == "remote_leak", "check_unique_me_content"),
        (kind.isin("double_talk", "timing_overlap"), "confirm_benign"),
    )
    action = ladder(
        "classify_audio",
        ((kind == "remote_duplicate") & error & hint, "confirm_drop_or_keep_me"),
        ((kind == "remote_duplicate") & error, "check_unique_me_content"),
        ((kind == "asr_noise") & error, "confirm_drop_or_keep_me"),
        (kind == "remote_leak", "check_unique_me_content"),
        (kind == "lost_me", "check_lost_local_speech"),
        (kind == "local_recall_needs_review", "check_local_recall_island"),
        (kind == "local_recall_repair_inserted", "check_inserted_local_recall_repair"),
        (kind.isin("probable_order_risk", "needs_review", "transcript_order_needs_review") & (source == "transcript_order"), "check_transcript_order"),
        (kind.isin("double_talk", "timing_overlap"), "confirm_benign_overlap"),
    )
    return rows.select("*", lane.alias("review_lane"), action.alias("review_action"))


def suggested_decision(rows: DataFrame) -> DataFrame:
    """decision and decision_confidence that a reviewer is shown, by label, verdict and confidence."""
    kind, error, sure = label("label"), label("verdict") == "probable_transcript_error", num("confidence") >= 0.9
    duplicate, noise = (kind == "remote_duplicate") & error, (kind == "asr_noise") & error
    drops = (duplicate & drop_hint_allowed()) | noise
    benign = kind.isin("double_talk", "timing_overlap")
    middle = duplicate | kind.isin("remote_leak", "lost_me", "local_recall_repair_inserted", "probable_order_risk", "transcript_order_needs_review")
    decision = ladder("needs_review", (drops, "drop_me"), (benign, "keep_me"))
    level = ladder("low", (drops & sure, "high"), (drops | middle, "medium"))
    return rows.select("*", decision.alias("decision"), level.alias("decision_confidence"))


# Decisions that a reviewer may give, and those that leave an item open.
DECISIONS = ["drop_me", "drop_remote", "keep_me", "needs_review", "skip", "todo", ""]
OPEN = ["", "todo"]


def validate_decisions(rows: DataFrame, valid: list[str] = DECISIONS, still_open: list[str] = OPEN) -> DataFrame:
    """invalid_reason of decisions, null for valid ones: of several reasons the last one counts. Reads decision, allowed array<string>, source."""
    decision, allowed = F.trim(label("decision")), F.coalesce("allowed", F.array().cast("array<string>"))
    recall, order = label("source").isin("local_recall", "local_recall_repair"), label("source") == "transcript_order"
    reasons = [
        (~decision.isin(valid), F.lit("unknown_decision")),
        (~decision.isin(still_open) & (F.size(allowed) > 0) & ~F.array_contains(allowed, decision), F.lit("decision_not_allowed_for_row")),
        (recall & decision.isin("drop_me", "drop_remote"), F.concat(decision, F.lit("_is_not_supported_for_local_recall"))),
        (recall & (decision == "keep_me"), F.lit("keep_me_requires_materialized_local_recall_utterance")),
        (order & decision.isin("drop_me", "drop_remote"), F.concat(decision, F.lit("_is_not_supported_for_transcript_order"))),
    ]
    return rows.withColumn("invalid_reason", F.coalesce(*[F.when(c, r) for c, r in reversed(reasons)]))


def order_blocking(rows: DataFrame) -> DataFrame:
    """blocking of order mismatches by role_mismatch, ambiguous, plausible (the larger of both matches), margin and content (the smaller)."""
    weak = (num("plausible") >= 3) & ((num("margin") <= 0.20) | (num("content") <= 3))
    return rows.withColumn("blocking", F.when(yes("role_mismatch"), True).when(yes("ambiguous") | weak, False).otherwise(True))


def order_risk(rows: DataFrame, least_overlap: float = 0.5, long_me: float = 6.0, tail: float = 0.8) -> DataFrame:
    """order_label and order_confidence of an overlap of a Me turn with a remote turn, by their bounds in seconds, similarity and overlap_type."""
    ms, me, rs, re = (num(c) for c in ("me_start", "me_end", "remote_start", "remote_end"))
    shared = F.greatest(F.least(me, re) - F.greatest(ms, rs), F.lit(0.0))
    wraps, inside = (ms < rs) & (me > re), (rs >= ms + 0.2) & (re <= me - 0.2)
    long, crosses = me - ms >= long_me, wraps & (re - rs >= 0.8) & (me - re >= tail)
    steps = [
        ((num("similarity") >= 0.70) | (label("overlap_type") == "probable_duplicate_unresolved"), "probable_duplicate", F.lit(0.82)),
        (shared < least_overlap, "short_overlap", F.lit(0.72)),
        (long & crosses, "probable_order_risk", F.when(inside, 0.86).otherwise(0.78)),
        (long & (shared >= 2.0), "needs_review", F.lit(0.68)),
        (shared <= 2.0, "likely_timing_overlap", F.lit(0.74)),
    ]
    sure = F
    for condition, _, value in steps:
        sure = sure.when(condition, value)
    return rows.select("*", ladder("possible_double_talk", *[(c, n) for c, n, _ in steps]).alias("order_label"), sure.otherwise(0.64).alias("order_confidence"))


def order_risk_runtime(rows: DataFrame) -> DataFrame:
    """risk and disposition of two live turns whose matched batch turns are the other way round.

    Reads prev_/cur_ start, end, batch_start, margin, plausible, inside, source and role_ok, and ambiguous, batch_delta, legacy_advisory.
    """
    ps, pe, cs, ce = (num(c) for c in ("prev_start", "prev_end", "cur_start", "cur_end"))
    apart, shared = F.greatest(cs - pe, F.lit(0.0)), F.greatest(pe - cs, F.lit(0.0))
    error = F.greatest(F.abs(num("prev_batch_start") - ps), F.abs(num("cur_batch_start") - cs))
    margin, plausible = F.least(num("prev_margin", 1.0), num("cur_margin", 1.0)), F.greatest(num("prev_plausible"), num("cur_plausible"))
    outside = ~(yes("prev_inside") & yes("cur_inside"))
    same, unclear = (label("prev_source") != "") & (label("prev_source") == label("cur_source")), yes("ambiguous")
    separated = label("prev_source").startswith("separated") | label("cur_source").startswith("separated")
    steps = [
        (~(yes("prev_role_ok") & yes("cur_role_ok")), "real_role_conflict"),
        (cs < ps, "real_timeline_conflict"),
        ((error >= 120) & (plausible >= 5) & (unclear | (margin <= 0.25) | outside), "matcher_temporal_false_positive"),
        ((shared >= 0.2) & ~same, "causal_cross_source_overlap"),
        (shared >= 0.2, "causal_same_source_overlap_context"),
        (~same & separated & (error >= 10) & ((margin <= 0.25) | (plausible >= 5) | outside), "matcher_temporal_false_positive"),
        ((apart > 1) & (num("batch_delta") < -1) & ~unclear & (margin >= 0.25) & (plausible <= 2) & (error <= 5), "real_timeline_conflict"),
        ((apart <= 1) & unclear & (margin <= 0.20) & (plausible >= 2) & outside, "matcher_ambiguous_reference"),
        (yes("legacy_advisory") & (unclear | (margin <= 0.25) | (plausible >= 5)), "matcher_ambiguous_reference"),
    ]
    out = rows.withColumn("risk", ladder("unresolved", *steps))
    return out.withColumn("disposition", F.when(F.col("risk").rlike("^(real_|unresolved)"), "blocking").otherwise("advisory"))


def chronology(rows: DataFrame) -> DataFrame:
    """chronology and its confidence for an order risk, by the audio evidence of its group and an optional judge. identity_ok null: no group evidence."""
    # fixed values of the policy: local evidence 60, clean level -52 dB, remote level -48 dB, judge 0.78, timing 0.75, leak 70
    group, sure, judge, judge_sure = label("group_label"), num("group_confidence"), label("judge_label"), num("judge_confidence")
    local = (num("local_evidence") >= 60) & (num("clean_rms", -120.0) >= -52) & (num("audio_leak") < 90)
    active = (num("remote_rms", -120.0) >= -48) | (num("remote_only") >= 0.20) | (num("double_talk") >= 0.10)
    judged = judge.isin("confirm_me", "confirm_timing_or_doubletalk") & (judge_sure >= 0.78)
    timing = (group == "probable_timing_overlap") & (sure >= 0.75) & yes("near_boundary") & (num("similarity") < 0.55) & (num("audio_leak") < 70) & local
    talk = (group == "probable_double_talk") & (sure >= 0.70) & local & active
    agree = judged & local & ((num("remote_rms", -120.0) < -48) | (num("double_talk") >= 0.10) | group.isin("probable_timing_overlap", "probable_double_talk"))
    harmful = group.isin("probable_duplicate", "probable_remote_leak", "probable_asr_noise")
    damaged = (label("order_label") == "probable_order_risk") & yes("wraps") & (num("tail_sec") >= 0.8)
    steps = [
        (~yes("identity_ok"), "insufficient_evidence", F.lit(0.0)),
        (harmful, "remote_leak_or_asr_segmentation", sure),
        (talk | (agree & active), "confirmed_double_talk", F.greatest(F.when(talk, sure).otherwise(0.0), judge_sure)),
        (timing | agree, "benign_turn_boundary", F.when(timing & ~judged, sure).otherwise(F.greatest(F.when(timing, sure).otherwise(0.0), judge_sure))),
        (damaged, "true_chronology_risk", num("order_confidence")),
    ]
    confidence = F
    for condition, _, value in steps:
        confidence = confidence.when(condition, value)
    return rows.select("*", ladder("insufficient_evidence", *[(c, n) for c, n, _ in steps]).alias("chronology"), confidence.otherwise(F.greatest(sure, judge_sure)).alias("chronology_confidence"))


def integrity(rows: DataFrame) -> DataFrame:
    """outcome (apply or needs_review), outcome_confidence and reason of a proposed text repair, by proof or an independent transcript of the judge."""
    kind, exact, fuzzy, gain = label("kind"), num("exact_count"), num("fuzzy_support"), num("repaired_similarity") - num("original_similarity")
    loop = (kind == "decoder_repetition_loop", (num("repeat_count") >= 4) & (exact == 0) & (fuzzy < 0.55) & (num("rms_db") <= -55), "silent_decoder_loop_rejected_by_independent_asr", F.lit(0.99), "repetition_loop_not_independently_disproved")
    inner = (kind == "internal_exact_repeat", (exact <= 1) & (fuzzy >= 0.72) & (num("repaired_similarity") >= 0.48) & (gain >= 0.04), "single_repeat_supported_by_independent_asr", F.round(F.least(F.lit(0.99), 0.82 + F.greatest(gain, F.lit(0.0))), 6), "independent_asr_does_not_prove_internal_duplicate")
    beside = (kind == "adjacent_exact_repeat", (exact == 1) & (fuzzy >= 0.80), "single_utterance_supported_by_independent_asr", F.lit(0.9), "independent_asr_does_not_prove_adjacent_duplicate")
    judged = label("judge_status") == "ok"
    reason = F.when(yes("deterministic_safe"), "deterministic_duplicate_proof").when(~judged, F.coalesce("judge_reason", F.lit("local_judge_unavailable")))
    sure = F.when(yes("deterministic_safe"), 1.0).when(~judged, 0.0)
    apply = yes("deterministic_safe")
    for is_kind, holds, good, value, bad in (loop, inner, beside):
        reason, sure = reason.when(is_kind & holds, good).when(is_kind, bad), sure.when(is_kind & holds, value).when(is_kind, 0.5)
        apply = apply | (judged & is_kind & holds)
    return rows.select("*", F.when(apply, "apply").otherwise("needs_review").alias("outcome"), sure.otherwise(0.0).alias("outcome_confidence"), reason.otherwise("unsupported_candidate_kind").alias("reason"))


def prefilter(rows: DataFrame, margin: float = 0.15, similarity: float = 0.88, recall: float = 0.65) -> DataFrame:
    """route of a live candidate by past evidence alone: contract_ok, seeds, target_margin (may be null), remote_similarity (null without remote text), remote_recall."""
    near = yes("contract_ok") & (num("seeds") > 0) & F.coalesce(F.col("target_margin") >= margin, F.lit(False))
    copied = yes("contract_ok") & F.col("remote_similarity").isNotNull() & (num("remote_similarity") >= similarity) & (num("remote_recall") >= recall)
    return rows.withColumn("route", ladder("unresolved", (near, "expensive_candidate"), (copied, "cheap_reject")))


def protected_marker() -> Column:
    """A marker keeps a turn unless the evidence is very sure and nearly all of its content is said elsewhere."""
    sure, unique = num("confidence") >= 0.95, num("unique_tokens")
    return yes("has_marker") & ~(sure & ((unique == 0) | ((unique <= 2) & ~yes("notes_impact"))))


def intentional_repeat() -> Column:
    """An agreement with content of its own, or a reply or boundary turn with strong local evidence."""
    gap = num("me_start") - num("remote_end")
    local = (num("local_evidence") >= 45) | (num("local_score_max") >= 0.65) | (num("local_only") >= 0.25)
    return (num("unique_tokens") >= 3) & (yes("starts_with_agreement") | (local & (((gap >= -0.2) & (gap <= 2.5)) | yes("near_boundary"))))


def duplicate_gate() -> Column:
    sure, text = num("confidence"), num("text_duplicate")
    very = (sure >= 0.95) & (text >= 95)
    text_ok = (text >= 85) | ((num("similarity") >= 0.78) & (num("containment") >= 0.75)) | very
    local_ok = ((num("local_evidence") <= 45) & (num("local_only") < 0.70) & (num("double_talk") < 0.75)) | (very & (num("unique_tokens") <= 2))
    covered = (num("coverage") >= 0.80) | (very & (num("coverage") >= 0.50))
    noted = yes("notes_impact") & ~((sure >= 0.95) & (num("unique_tokens") == 0))
    return (label("label") == "probable_duplicate") & (sure >= 0.88) & text_ok & local_ok & covered & (num("unique_tokens") <= 2) & ~protected_marker() & ~intentional_repeat() & ~noted


def _short_noise() -> Column:
    return (num("duration_sec") <= 2.5) & (num("content_tokens") <= 3) & (num("domain_terms") == 0) & ~yes("has_marker")


def noise_gate() -> Column:
    return (label("label") == "probable_asr_noise") & (num("confidence") >= 0.85) & _short_noise() & (num("local_evidence") <= 25) & (num("local_only") < 0.20)


def judge_gate(profile: str = "audit_cleanup_v4") -> Column:
    """Whether an audio judge may have a turn dropped; a judge that only marks never may. review_safe: what the review gate said."""
    sure, kept = num("judge_confidence"), protected_marker() | intentional_repeat()
    base = (label("verdict") == "probable_transcript_error") & (label("judge_label") == "drop_error") & ~kept
    common = base & (sure >= 0.98) & ~(yes("notes_impact") & ~((sure >= 0.995) & (num("unique_tokens") == 0)))
    likeness, unique = (num("similarity") >= 0.60) | (num("containment") >= 0.65) | (num("duplicate_score") >= 90), num("unique_tokens") <= 2
    duplicate = (label("label") == "remote_duplicate") & common & (num("duplicate_score") >= 75) & (num("local_evidence") <= 60) & likeness & (num("coverage") >= 0.45) & unique
    noise = (label("label") == "asr_noise") & common & (num("noise_score") >= 75) & (num("local_evidence") <= 45) & _short_noise()
    wider = F.lit(profile == "audit_cleanup_v4") & base & (sure >= 0.93) & ~yes("notes_impact") & (label("label") == "remote_duplicate") & (num("duplicate_score") >= 82)
    wider = wider & (num("local_evidence") <= 55) & (num("similarity") >= 0.75) & (num("containment") >= 0.75) & (num("coverage") >= 0.60) & unique
    return (label("judge_label") != "mark_only_error") & (yes("review_safe") | duplicate | noise | wider)


def local_recall(rows: DataFrame) -> DataFrame:
    """recall_label and recall_confidence of a local island that no Me turn covers."""
    seconds, n, db = num("duration_sec"), num("content_tokens"), F.when(num("mic_db", -120.0) == 0, -120.0).otherwise(num("mic_db", -120.0))
    local, double, remote = num("local_only"), num("double_talk"), num("remote_active")
    marker, edge = yes("has_marker"), yes("boundary_fragment")
    steps = [
        (seconds < 0.55, "likely_harmless_short", F.lit(0.74)),
        ((n >= 3) & (num("remote_coverage") >= 0.70), "likely_harmless_remote_covered", F.lit(0.82)),
        (edge & (n >= 3) & (num("remote_coverage") >= 0.50), "likely_harmless_remote_boundary_covered", F.lit(0.8)),
        (yes("acknowledgement") & ~marker & (seconds <= 1.6), "likely_harmless_ack_fragment", F.lit(0.79)),
        (edge & ~marker, "likely_harmless_boundary_fragment", F.lit(0.77)),
        ((local >= 0.55) & (db > -52) & (seconds >= 1.2), "possible_lost_me", F.when(marker | (n >= 4), 0.84).otherwise(0.78)),
        ((local + double >= 0.55) & (seconds >= 0.9) & (db > -55), "needs_review", F.lit(0.68)),
        (marker & (seconds >= 0.8) & (db > -58), "needs_review", F.lit(0.64)),
        ((remote >= 0.65) & (local < 0.25), "likely_harmless_remote_guard", F.lit(0.76)),
        (db <= -55, "likely_harmless_weak_audio", F.lit(0.72)),
    ]
    sure = F
    for condition, _, value in steps:
        sure = sure.when(condition, value)
    return rows.select("*", ladder("needs_review", *[(c, n_) for c, n_, _ in steps]).alias("recall_label"), sure.otherwise(0.6).alias("recall_confidence"))


def recall_summary(items: DataFrame, by: str) -> DataFrame:
    """by, seconds lost, under review and harmless, and whether they block: anything possibly lost, or five seconds of both."""
    seconds, kind = num("duration_sec"), F.col("recall_label")
    sums = [F.sum(F.when(c, seconds).otherwise(0.0)).alias(n) for c, n in ((kind == "possible_lost_me", "lost_sec"), (kind == "needs_review", "review_sec"), (kind.startswith("likely_harmless"), "harmless_sec"))]
    out = items.groupBy(by).agg(F.count("*").alias("items"), F.count_if(kind == "possible_lost_me").alias("lost"), *sums)
    blocking = (F.col("lost") > 0) | (F.col("lost_sec") + F.col("review_sec") >= 5)
    return out.withColumn("blocking", blocking).withColumn("next_step", ladder("local_recall_risk_explained", (blocking, "review_local_recall_items")))


def verdict(rows: DataFrame) -> DataFrame:
    """verdict of a session's transcript: failed, risky, usable_with_review or good.

    audited: the profile comes from an audit and has its figures; only these decide then, after fatal items and emptiness.
    """
    seconds = F.greatest(F.lit(1.0), num("duration_sec"))
    harmful, review, recall = num("harmful_sec"), num("review_sec"), num("local_recall", 1.0)

    def beyond(least_harm: float, harm: float, least_review: float, share: float) -> Column:
        return (harmful > F.greatest(F.lit(least_harm), seconds * harm)) | (review > F.greatest(F.lit(least_review), seconds * share))

    unexplained, audited = ~yes("recall_explained"), yes("audited")
    remains = (num("needs_review") > 0) | (num("long_overlaps") > 0)
    high = yes("high_risk") | yes("shadow_unproven") | (num("long_crossings") > 0) | (num("golden_failures") > 0) | (num("needs_ratio") > 0.12) | (num("duplicate_sec") > 180)
    medium = yes("medium_risk") | remains | (num("duplicate_sec") > 0)
    steps = [
        (yes("fatal_risk"), "failed"),
        ((num("utterances") <= 0) & yes("verified_no_speech"), "good"),
        (num("utterances") <= 0, "failed"),
        (audited & (((recall < 0.70) & unexplained) | beyond(180, 0.06, 900, 0.35)), "failed"),
        (audited & (((recall < 0.80) & unexplained) | beyond(90, 0.03, 300, 0.12)), "risky"),
        (audited & (yes("partial_scope") | beyond(30, 0.01, 60, 0.03) | remains), "usable_with_review"),
        (audited, "good"),
        (high, "risky"),
        (medium, "usable_with_review"),
    ]
    return rows.withColumn("session_verdict", ladder("good", *steps))


def overlap_scores(rows: DataFrame) -> DataFrame:
    """Scores from 0 to 100, whole numbers, of what an overlap may be: evidence first, then five categories."""

    def score(x: Column) -> Column:
        return F.round(clamp(x, 0, 100))

    similar, words, boundary, short = num("similarity"), num("me_tokens"), yes("near_boundary"), yes("backchannel")
    plain = num("clean_corr") < 0.16
    masked = num("masked_rms", -120.0) <= -55
    rows = rows.withColumn("s_local", score(points((num("local_score") >= 0.65, 35), (num("local_only") >= 0.50, 25), (num("double_talk") >= 0.40, 20), ((num("clean_rms", -120.0) > -45) & plain, 15), (short & (similar < 0.60), 10), (num("remote_only") >= 0.60, -25), (masked, -20))))
    rows = rows.withColumn("s_leak", score(points((num("raw_corr") >= 0.25, 30), (yes("lag_consistent"), 20), (num("mel_cosine") >= 0.72, 20), (num("coherence") >= 0.35, 15), (num("energy_drop_db") <= -12, 15), ((num("clean_rms", -120.0) > -42) & plain, -25))))
    local, leak = F.col("s_local"), F.col("s_leak")
    rows = rows.withColumn("s_remote", score(points((num("remote_active") >= 0.70, 30), (num("remote_only") >= 0.50, 25), (leak >= 70, 20), (yes("lag_consistent"), 15), (similar >= 0.75, 15), (local >= 65, -25))))
    rows = rows.withColumn("s_text", score(points((similar >= 0.75, 35), (num("containment") >= 0.80, 25), (num("term_overlap") >= 0.60, 20), (num("time_overlap") >= 0.50, 15), (short & (similar < 0.60), -20))))
    text, remote = F.col("s_text"), F.col("s_remote")
    quiet = num("silence") + num("remote_only") >= 0.60
    made = {
        "probable_duplicate": F.greatest(F.when((text >= 70) & (local < 55), text + 5).otherwise(0.0), F.when((similar >= 0.65) & (num("remote_only") >= 0.50) & (num("local_score") < 0.40), 78.0).otherwise(0.0)),
        "probable_remote_leak": F.when((leak >= 70) & (local < 50) & (remote >= 60), leak).when((leak >= 60) & (num("remote_only") >= 0.50) & (local < 45), 68.0).otherwise(0.0),
        "probable_double_talk": F.greatest(F.when((local >= 65) & (num("remote_active") >= 0.50) & (similar < 0.60), local + 5).otherwise(0.0), F.when((num("double_talk") >= 0.40) & (num("clean_rms", -120.0) > -50) & (leak < 70) & (similar < 0.60), 75.0).otherwise(0.0)),
        "probable_timing_overlap": F.when((similar < 0.45) & (leak < 55) & (local >= 45) & boundary, 75.0).when(boundary & (num("time_overlap") < 0.25) & (similar < 0.55), 68.0).otherwise(0.0),
        "probable_asr_noise": F.when(short & (local < 45) & masked, 78.0).when((words <= 2) & quiet & (local < 45), 70.0).otherwise(0.0),
    }
    return rows.select("*", *[score(x).alias(n) for n, x in made.items()])


# Overlap categories in their order, with what is suggested for each.
CATEGORIES = {"probable_duplicate": "drop_me_duplicate", "probable_remote_leak": "drop_me_or_mark_remote_leak", "probable_double_talk": "mark_double_talk", "probable_timing_overlap": "mark_timing_overlap", "probable_asr_noise": "drop_me_noise"}


def overlap_label(rows: DataFrame) -> DataFrame:
    """overlap_label, overlap_confidence and suggestion: the best category (ties: first in order) if it scores 70, leads by 12, and 82 beyond eight seconds."""
    names = list(CATEGORIES)
    ranked = F.sort_array(F.array(*[F.struct(F.col(n).alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("k")) for i, n in enumerate(names)]), asc=False)
    out = rows.withColumn("_r", ranked)
    top, second = F.get("_r", F.lit(0)), F.get("_r", F.lit(1))
    unclear = (top["s"] < 70) | (top["s"] - second["s"] < 12) | ((num("duration_sec") > 8) & (top["s"] < 82))
    sure = F.when(unclear, clamp(top["s"] / 100, 0, 0.69)).otherwise(clamp(top["s"] / 100, 0.7, 0.99))
    hint = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    return out.select("*", F.when(unclear, "needs_human_review").otherwise(top["k"]).alias("overlap_label"), F.round(sure, 3).alias("overlap_confidence"), F.when(unclear, "needs_review").otherwise(hint[top["k"]]).alias("suggestion")).drop("_r")


def target_voice(rows: DataFrame) -> DataFrame:
    """voice_label, voice_confidence and voice_decision by similarities to an enrolled voice (enrolled false: none), speaker states and other evidence."""
    strong, weak = num("target_threshold", 0.45), num("weak_threshold", 0.38)
    best, remote, active = num("best_mic"), num("remote_similarity"), num("remote_active")
    lead = best - remote
    drop = ((label("audio_verdict") == "probable_transcript_error") & label("audio_label").isin("remote_duplicate", "remote_leak", "asr_noise", "uncertain")) | label("judge_label").isin("confirm_remote_duplicate", "confirm_asr_noise")
    keep = label("judge_label").isin("confirm_me", "confirm_timing_or_doubletalk")
    steps = [
        (~yes("enrolled"), "target_me_ambiguous", F.lit(0.0)),
        ((best >= strong) & (lead >= 0.08), "target_me_confirmed", clamp(0.55 + best * 0.35 + F.greatest(lead, F.lit(0.0)) * 0.45, 0.72, 0.94)),
        ((best >= weak) & ((num("local_score") >= 0.25) | (num("double_talk") >= 0.20) | keep), "target_me_possible", clamp(best + 0.10, 0.55, 0.78)),
        ((best < weak) & (active >= 0.45) & drop, "target_me_absent_remote_like", clamp(0.62 + (weak - best) * 0.35 + active * 0.15, 0.70, 0.90)),
        ((best < weak) & (num("local_only") < 0.20) & (active >= 0.35), "target_me_absent", clamp(0.50 + (weak - best) * 0.30 + active * 0.12, 0.55, 0.76)),
    ]
    sure = F
    for condition, _, value in steps:
        sure = sure.when(condition, value)
    out = rows.select("*", ladder("target_me_ambiguous", *[(c, n) for c, n, _ in steps]).alias("voice_label"), sure.otherwise(F.least(F.lit(0.69), F.greatest(best, remote, F.lit(0.40)))).alias("_sure"))
    long = F.col("voice_label").isin("target_me_absent_remote_like", "target_me_absent") & (num("me_tokens") >= 8)
    decision = ladder("needs_review", (F.col("voice_label") == "target_me_confirmed", "keep_me"), ((F.col("voice_label") == "target_me_absent_remote_like") & ~long, "drop_me_evidence_only"))
    return out.select("*", F.round(F.when(long, F.least("_sure", F.lit(0.74))).otherwise(F.col("_sure")), 3).alias("voice_confidence"), decision.alias("voice_decision")).drop("_sure")


def role_decision(rows: DataFrame, keep_all: bool = False) -> DataFrame:
    """role_action (keep, keep_needs_review, drop or a repair's own) , role_reason and role_confidence of a candidate, by its best remote match (matched) and echo shares."""
    overlap, similar, terms = num("time_overlap"), num("similarity"), num("term_overlap")
    active, local, double, score, support = num("remote_active"), num("local_only"), num("double_talk"), num("local_score"), num("local_support_sec")
    duplicate = points((overlap > 0.50, 0.25), (similar > 0.70, 0.35), ((similar <= 0.70) & (similar > 0.55) & (terms > 0.40), 0.25), (active > 0.70, 0.15), (score < 0.25, 0.20), (num("no_speech") > 0.60, 0.10), (double > 0.30, -0.20), (local > 0.60, -0.40))
    duplicate = clamp(F.round(duplicate, 6), 0, 1)
    repair, matched = label("repair_action"), yes("matched")
    repaired = (label("track") == "mic") & repair.isin("split", "micro_reasr", "keep_needs_review", "drop")
    doubtful = yes("repair_needs_review") | (repair == "keep_needs_review")
    leak = matched & (active > 0.70) & (score < 0.30)
    steps = [
        (repaired, repair, F.coalesce("repair_reason", F.lit("timeline_repair_local_island")), F.when(repair == "drop", 0.84).when(doubtful, 0.55).otherwise(0.78)),
        (yes("weak_phrase") & yes("isolated"), F.lit("drop"), F.lit("weak_isolated_hallucination"), F.lit(0.72)),
        (label("track") == "remote", F.lit("keep"), F.lit("authoritative_remote"), F.lit(0.9)),
        (F.lit(keep_all), F.lit("keep"), F.lit("mic_policy_keep_all"), F.lit(0.5)),
        (local > 0.80, F.lit("keep"), F.lit("strong_local_only"), F.lit(0.9)),
        (leak & (overlap > 0.70) & ((num("duration_sec") < 4) | (similar > 0.45) | (support < 0.5)), F.lit("drop"), F.lit("remote_leak_echo_overlap"), F.lit(0.84)),
        (leak & (support >= 0.5) & (similar <= 0.45), F.lit("keep_needs_review"), F.lit("local_support_inside_remote_active"), F.lit(0.55)),
        (matched & (overlap > 0.70) & (score < 0.20), F.lit("drop"), F.lit("remote_leak_time_overlap"), F.lit(0.88)),
        ((active >= 0.95) & (score <= 0.05), F.lit("drop"), F.lit("echo_guard_remote_active"), F.lit(0.82)),
        (duplicate >= 0.70, F.lit("drop"), F.lit("remote_duplicate"), duplicate),
        ((duplicate >= 0.55) & ((similar > 0.45) | (overlap > 0.50)), F.lit("drop"), F.lit("probable_remote_duplicate"), duplicate),
        (duplicate >= 0.45, F.lit("keep_needs_review"), F.lit("uncertain_overlap"), 1 - duplicate),
    ]
    action = reason = sure = F
    for condition, a, r, s in steps:
        action, reason, sure = action.when(condition, a), reason.when(condition, r), sure.when(condition, s)
    return rows.select("*", action.otherwise("keep").alias("role_action"), reason.otherwise("mic_local_candidate").alias("role_reason"), sure.otherwise(1 - duplicate).alias("role_confidence"))


def unit_gate(rows: DataFrame, least: float = 1.0, most: float = 12.0) -> DataFrame:
    """unit_reason of remote turns that can't be voice evidence, null for those that can; turns of other roles are left out."""
    seconds = F.col("end").cast("double") - F.col("start").cast("double")
    reason = F.when(seconds.isNull(), "invalid_interval").when(yes("needs_review"), "source_needs_review").when(seconds < least, "too_short_for_voice_evidence")
    reason = reason.when(seconds > most, "too_long_for_single_speaker_evidence").when(F.trim(label("text")) == "", "empty_text")
    return rows.filter(label("role") == "remote").withColumn("unit_reason", reason)


def needs_attention(bucket: list[str], actions: list[str]) -> Column:
    """An item in one of the buckets, or told wrong by cross-validation, or with one of the actions."""
    return label("bucket").isin(bucket) | (F.col("cv_correct") == F.lit(False)).eqNullSafe(F.lit(True)) | label("action").isin(actions)


def content_class(key: Column, path: Column) -> Column:
    """Class of an artifact by its key or its lower-cased file name: the first that fits."""
    key, name = F.coalesce(key, F.lit("")), F.lower(F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1))

    def either(word: str) -> Column:
        return key.contains(word) | name.contains(word)

    return ladder(
        "export_file",
        (either("transcript") | name.contains("clean_dialogue"), "transcript_or_dialogue"),
        (either("notes"), "meeting_notes"),
        (either("quality") | key.contains("verdict"), "quality_metadata"),
        (either("review"), "review_metadata"),
        (name.endswith(".json"), "evidence_json"),
    )


def acoustic_mode(windows: DataFrame, by: str) -> DataFrame:
    """by, mode, mode_confidence from windows(by, state, similarity): how much remote sound reaches the microphone while only the remote side speaks.

    A quantile is the value at floor(n * q), not an interpolated one; values are counted before they are ranked.
    """
    # fixed values: five windows; coupled from 0.04; ratios 0.30 and 0.15; limits 0.03 and 0.06
    x = F.coalesce("similarity", F.lit(0.0))
    counts = windows.filter(F.col("state") == "remote_only").groupBy(by, x.alias("x")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by)
    counts = counts.withColumn("c", F.sum("n").over(w.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))).withColumn("t", F.sum("n").over(w))

    def quantile(q: float) -> Column:
        at = F.least(F.floor(F.col("t") * q), F.col("t") - 1)
        return F.min(F.when(F.col("c") > at, F.col("x")))

    s = counts.groupBy(by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") >= 0.04, F.col("n")).otherwise(0)).alias("k"), quantile(0.75).alias("p75"), quantile(0.90).alias("p90"))
    s = windows.select(by).distinct().join(s, by, "left").fillna(0, ["n", "k"]).fillna(0.0, ["p75", "p90"])
    ratio = F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0)
    few, loud = F.col("n") < 5, (ratio >= 0.30) & (F.col("p75") >= 0.04)
    low = (ratio <= 0.15) & (F.col("p75") <= 0.03) & (F.col("p90") <= 0.06)
    sure = F.when(few, 0.0).when(loud, F.when((ratio >= 0.50) & (F.col("p75") >= 0.08), 0.9).otherwise(0.75)).when(low, F.when((ratio <= 0.10) & (F.col("p75") <= 0.02), 0.9).otherwise(0.75)).otherwise(0.5)
    return s.select(by, ladder("uncertain", (few, "uncertain"), (loud, "speaker_playback"), (low, "headphones_or_low_leak")).alias("mode"), sure.alias("mode_confidence"))


def low_materiality() -> Column:
    """Whether a review item hardly matters: short, already said, or a word of agreement. Nothing with a protected marker, but for a tiny overlap at a boundary."""
    kind, verdict, seconds, content = label("label"), label("verdict"), num("duration_sec"), num("content_tokens")
    error, plain = verdict == "probable_transcript_error", ~yes("protected_marker")
    similar, inside, covered, sure = num("similarity"), num("containment"), num("coverage"), num("confidence")
    lost = (seconds > 0) & (seconds <= 1.5) & (num("tokens") <= 3) & (content <= 2) & (sure <= 0.75) & plain
    reply = yes("remote_backchannel") & (num("overlap_sec") > 0) & (num("overlap_sec") <= 8) & (num("lead_sec") <= 1)
    order = (kind == "needs_review") & (verdict == "needs_transcript_order_review") & plain & ((content <= 2) | reply) & (similar <= 0.30) & (inside <= 0.05) & ~yes("remote_inside") & ~yes("wraps")
    tiny = (seconds > 0) & (seconds <= 0.5) & (covered <= 0.05) & yes("partial")
    most = F.when(yes("backchannel"), 3.0).when(content <= 1, 2.0).otherwise(1.25)
    other = kind != "remote_duplicate"
    exact = ~other & (sure >= 0.95) & (covered >= 0.80) & ((similar >= 0.92) | (inside >= 0.75) | yes("fuzzy_duplicate"))
    part = ~other & (sure >= 0.95) & (seconds <= 1) & (content <= 2) & yes("partial") & (similar >= 0.92) & (inside >= 0.75)
    told = (other & (content <= 1)) | (covered <= 0.40) | tiny | (yes("backchannel") & (seconds <= 4)) | (other & yes("fuzzy_duplicate")) | exact | part | (other & (content <= 2) & (similar <= 0.30) & (inside <= 0.25))
    known = kind.isin("remote_duplicate", "remote_leak", "uncertain") & verdict.isin("probable_transcript_error", "needs_stronger_audio_judge") & (seconds > 0)
    return F.when((kind == "lost_me") & error, lost).when(label("source") == "transcript_order", order).when(~known | (~tiny & (~plain | (seconds > most))), False).otherwise(told)


def pending(made_for: Column, profile: Column, cumulative: Column) -> Column:
    """Whether a decision counts for a profile: made for it, for none in particular, or for any if the profile is reviewed and cumulative."""
    own = F.coalesce(made_for, F.lit(""))
    return (own == "") | (own == profile) | (cumulative & profile.isin("reviewed_v1", "agent_reviewed_v1"))
