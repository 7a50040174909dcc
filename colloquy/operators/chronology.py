"""Word-level chronology: texts of a disputed pair of turns aligned to the words of two decodes, and what their times prove."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.blocks import aligned
from colloquy.operators.joins import dealt


@dataclass(frozen=True)
class Thresholds:
    """Fixed values of the rule, in seconds, shares and points."""

    word_probability: float = 0.2
    containment: float = 0.5
    score: float = 0.6
    local_margin: float = 0.12
    sequential_overlap: float = 0.35
    double_talk_overlap: float = 0.5
    remote_only: float = 0.8
    remote_only_local_active: float = 0.1
    remote_only_local_evidence: float = 20


def word_times(texts: DataFrame, decodes: DataFrame, key: list[str], least: float = 0.2) -> DataFrame:
    """key, source and text's name, with `words`: (place, token, start, end, probability) of each word of the text that the decode has; the rest of the texts' words have null times.

    texts are rows(key, text, tokens), decodes rows(key, source, tokens, words), where words are structs(token, start, end,
    probability) in order, an array for each decode of one clip. Every text meets every decode of its key. Words under the
    least probability don't count as heard.
    """
    heard = decodes.withColumn("words", F.filter(F.coalesce("words", F.array().cast(decodes.schema["words"].dataType)), lambda w: w["probability"] >= least))
    both = dealt(texts.join(heard, key), *key)
    both = both.withColumn("at", aligned(F.col("tokens"), F.transform("words", lambda w: w["token"])))

    def word(i: Column) -> Column:
        return F.get("words", F.get("at", i))

    return both.withColumn("times", F.transform("tokens", lambda t, i: F.struct(i.alias("place"), t.alias("token"), word(i)["start"].alias("start"), word(i)["end"].alias("end"), word(i)["probability"].alias("probability")))).drop("at")


def alignment(times: Column, heard: Column, limits: Thresholds = Thresholds()) -> Column:
    """supported, score, matched, containment, precision, recall, start and end of a text from the times of its words and the number of words heard."""
    found = F.filter(times, lambda w: w["start"].isNotNull())
    n, m, k = F.size(times), heard, F.size(found)
    shorter = F.least(n, m)
    containment = F.when(shorter > 0, k / shorter).otherwise(0.0)
    precision, recall = F.when(m > 0, k / m).otherwise(0.0), F.when(n > 0, k / n).otherwise(0.0)
    mean = F.when(k > 0, F.aggregate(found, F.lit(0.0), lambda s, w: s + w["probability"]) / k).otherwise(0.0)
    score = 0.45 * containment + 0.35 * precision + 0.20 * mean
    supported = (k >= F.when(n == 1, 1).otherwise(2)) & (containment >= limits.containment) & (score >= limits.score)
    rounded = [F.round(c, 6).alias(name) for c, name in ((score, "score"), (containment, "containment"), (precision, "precision"), (recall, "recall"))]
    edges = [F.round(F.get(found, F.lit(0))["start"], 3).alias("start"), F.round(F.try_element_at(found, F.lit(-1))["end"], 3).alias("end")]
    return F.struct(supported.alias("supported"), rounded[0], k.alias("matched"), *rounded[1:], *edges)


def classify(items: DataFrame, decodes: DataFrame, key: list[str], limits: Thresholds = Thresholds()) -> DataFrame:
    """items with the alignments mic_me, mic_remote, remote_remote and remote_me, independent_local, actual_overlap, signed_gap, label, localized, confidence and reason.

    items are rows(key, me_tokens, remote_tokens, local_evidence, local_only, double_talk, remote_only, upstream); decodes are
    rows(key, source, status, words) with source mic_clean or remote, at most one of each for an item. A decode that is
    missing counts as one without words whose status is missing. Null evidence counts as 0, null tokens as an empty text.
    """
    empty = F.array().cast("array<string>")
    texts = items.select(*key, F.explode(F.array(*[F.struct(F.lit(who).alias("who"), F.coalesce(f"{who}_tokens", empty).alias("tokens")) for who in ("me", "remote")])).alias("t")).select(*key, "t.*")
    times = word_times(texts, decodes.select(*key, "source", "words"), key, limits.word_probability)
    ends = times.select(*key, "who", "source", alignment(F.col("times"), F.size("words"), limits).alias("a"), F.col("times").alias("w"))
    pairs = {"mic_me": ("mic_clean", "me"), "mic_remote": ("mic_clean", "remote"), "remote_remote": ("remote", "remote"), "remote_me": ("remote", "me")}
    picked = [F.max(F.when((F.col("source") == s) & (F.col("who") == w), F.struct("a", "w"))).alias(n) for n, (s, w) in pairs.items()]
    status = decodes.groupBy(*key).agg(*[F.max(F.when(F.col("source") == s, F.col("status"))).alias(f"{s}_status") for s in ("mic_clean", "remote")])
    out = items.join(ends.groupBy(*key).agg(*picked), key, "left").join(status, key, "left")
    for s in ("mic_clean", "remote"):
        out = out.withColumn(f"{s}_status", F.coalesce(f"{s}_status", F.lit("missing")))
    return _ladder(out, limits)


def _ladder(out: DataFrame, limits: Thresholds) -> DataFrame:
    def supported(name: str) -> Column:
        return F.coalesce(F.col(f"{name}.a.supported"), F.lit(False))

    def score(name: str) -> Column:
        return F.coalesce(F.col(f"{name}.a.score"), F.lit(0.0))

    def number(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    active = number("local_only") + number("double_talk")
    local = supported("mic_me") & ((score("mic_me") - score("mic_remote") >= limits.local_margin) | ((number("local_evidence") >= 60) & (active >= 0.5)))
    both = supported("mic_me") & supported("remote_remote")
    ms, me, rs, re = F.col("mic_me.a.start"), F.col("mic_me.a.end"), F.col("remote_remote.a.start"), F.col("remote_remote.a.end")
    out = out.withColumn("independent_local", local).withColumn("actual_overlap", F.when(both, F.round(F.greatest(F.lit(0.0), F.least(me, re) - F.greatest(ms, rs)), 6))).withColumn("signed_gap", F.when(both, F.round(F.greatest(ms, rs) - F.least(me, re), 6)))
    local, overlap = F.col("independent_local"), F.col("actual_overlap")
    moved = (number("remote_only") >= limits.remote_only) & (active <= limits.remote_only_local_active) & (number("local_evidence") <= limits.remote_only_local_evidence) & supported("remote_remote")
    moved &= ~local | F.coalesce(F.col("upstream") == "remote_leak_or_asr_segmentation", F.lit(False))
    timed = overlap.isNotNull() & local
    least, most = F.least(score("mic_me"), score("remote_remote")), F.greatest(score("mic_me"), score("remote_remote"))
    failed = (F.col("mic_clean_status") != "ok") | (F.col("remote_status") != "ok")
    ladder = [
        (moved, "transferred_remote_leak_or_segmentation", True, F.greatest(score("remote_remote"), F.lit(0.8)), "remote_only_state_and_remote_words_transfer_row_out_of_chronology"),
        (timed & (overlap <= limits.sequential_overlap), "localized_sequential_boundary", True, least, "word_timestamps_prove_non_overlapping_role_spans"),
        (timed & (overlap >= limits.double_talk_overlap), "localized_double_talk", True, least, "independent_role_words_overlap_on_shared_clip_timeline"),
        (failed, "evidence_unavailable", False, F.lit(0.0), "word_timestamp_decode_missing_or_failed"),
        (both & ~local, "conflicting_role_alignment", False, most, "mic_words_are_not_independent_from_remote_evidence"),
        (F.lit(True), "insufficient_word_alignment", False, most, "one_or_both_role_word_spans_are_not_localized"),
    ]
    result = F.coalesce(*[F.when(when, F.struct(F.lit(label).alias("label"), F.lit(done).alias("localized"), confidence.alias("confidence"), F.lit(reason).alias("reason"))) for when, label, done, confidence, reason in ladder])
    return out.withColumn("_r", result).select("*", "_r.*").drop("_r")
