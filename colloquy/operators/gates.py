"""Gates and measures over documents of any shape: rules and measures are tables of paths, applied to VARIANT documents by one join.

A rule is a condition on one path of one source's document; a gate passes if all its conditions hold. A measure is a sum, a count
or a median of one path over all documents. New rules and measures are rows, not columns or code.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.evaluation import percentiles
from colloquy.operators.joins import null_safe
from colloquy.operators.review import top_per_group

RULE = "source string, gate string, place int, kind string, path string, expected array<string>, other string, other_path string, tolerance double"
MEASURE = "measure string, kind string, path string, expected string"
_NOTHING = ("null", "false", "0", '""', "[]", "{}")


def rule(source: str, gate: str, kind: str, path: str, *expected: str, other: str | None = None, other_path: str | None = None, tolerance: float = 0.0) -> tuple:
    """A condition. Kinds: in (the text is one of expected), is (the JSON is expected), number, every (an object whose values are all true, and some), all (the same, or none; expected: keys left out), empty, same (as other's path, within the tolerance), hash (the SHA-256 of other's document)."""
    return source, gate, kind, path, list(expected), other, other_path, tolerance


def rules(spark: SparkSession, conditions: Iterable[tuple]) -> DataFrame:
    """Rows of RULE; conditions of a gate are numbered in their order, and the first gives what is observed."""
    seen: dict[tuple, int] = {}
    rows = []
    for source, gate, *rest in conditions:
        place = seen[source, gate] = seen.get((source, gate), -1) + 1
        rows.append((source, gate, place, *rest))
    return spark.createDataFrame(rows, RULE)


def _json(doc: str, path: str) -> Column:
    return F.to_json(F.try_variant_get(F.col(doc), F.col(path), "variant"))


def apply_gates(documents: DataFrame, table: DataFrame) -> DataFrame:
    """source, gate, passed and observed (JSON of the gate's first condition) for every gate of the table of rules.

    documents are rows(source, sha256, doc), doc a VARIANT, one for each source. A source without a document, and one whose
    document is null, has an empty one: conditions on it fail, except those that ask for nothing.
    """
    docs = documents.select("source", "sha256", "doc")
    other = docs.select(F.col("source").alias("other"), F.col("sha256").alias("_sha"), F.col("doc").alias("_doc"))
    both = table.join(docs.drop("sha256"), "source", "left").join(other, "other", "left")
    text, json = F.try_variant_get("doc", F.col("path"), "string"), _json("doc", "path")
    number, their = F.try_variant_get("doc", F.col("path"), "double"), F.try_variant_get("_doc", F.col("other_path"), "double")
    flags = F.map_filter(F.from_json(json, "map<string,string>"), lambda k, v: ~F.array_contains("expected", k))
    values = F.map_values(flags)
    true = F.forall(values, lambda v: F.coalesce(v == "true", F.lit(False)))
    object_ = F.substring(json, 1, 1) == "{"
    ok = {
        "in": F.array_contains("expected", text),
        "is": json == F.get("expected", F.lit(0)),
        "number": F.abs(number - F.get("expected", F.lit(0)).try_cast("double")) <= F.col("tolerance"),
        "every": object_ & (F.size(values) > 0) & true,
        "all": F.coalesce(json, F.lit("null")).isin(*_NOTHING) | (object_ & true),
        "empty": F.coalesce(json, F.lit("null")).isin(*_NOTHING),
        "same": F.coalesce(F.abs(number - their) <= F.col("tolerance"), json == _json("_doc", "other_path")),
        "hash": text == F.col("_sha"),
    }
    held = F.lit(False)
    for kind, condition in ok.items():
        held = F.when(F.col("kind") == kind, F.coalesce(condition, F.lit(False))).otherwise(held)
    out = both.select("source", "gate", "place", held.alias("held"), json.alias("observed"))
    return out.groupBy("source", "gate").agg(F.bool_and("held").alias("passed"), F.min_by("observed", "place").alias("observed"))


def failures(gates: DataFrame) -> DataFrame:
    """semantic_gate:source:gate of each gate that failed."""
    return gates.filter("not passed").select(F.concat_ws(":", F.lit("semantic_gate"), "source", "gate").alias("failure"))


#: The figures of a session's report that a corpus sums, as rows and as seconds.
CLOSURE = ("generated", "actionable", "needs_review", "todo", "auto", "auto_keep", "auto_drop", "auto_review", "manual_remaining")
FORBIDDEN_COUNTS = ("suggest_drop_count", "quarantine_count", "needs_review_count", "asr_windows_selected", "asr_windows_evaluable", "asr_windows_skipped")
FORBIDDEN_SECONDS = ("guarded_seconds", "review_burden_seconds", "suggest_drop_seconds", "quarantine_seconds", "needs_review_seconds")


def corpus_measures() -> list[tuple[str, str, str, str | None]]:
    """Rows of MEASURE of the corpus report. Kinds: rows, sum (whole numbers), seconds (to the millisecond), true, present and equal (counts of documents)."""
    out = [("session_count", "rows", "$", None), ("complete_pipeline_count", "equal", "$.pipeline_status", "complete"), ("partial_or_incomplete_count", "differ", "$.pipeline_status", "complete"), ("total_duration_sec", "seconds", "$.meeting_duration_sec", None)]
    out += [("sessions_with_suggested_review_v1", "true", "$.suggested_review_v1_available", None), ("sessions_with_suggested_closure", "present", "$.suggested_closure_status", None)]
    out += [(f"suggested_closure_{c}_{u}", k, f"$.suggested_closure_{c}_{u}", None) for c in CLOSURE for u, k in (("rows", "sum"), ("seconds", "seconds"))]
    out += [("remote_forbidden_sessions", "equal", "$.remote_forbidden_status", "ok"), ("remote_forbidden_gate_passed_sessions", "true", "$.remote_forbidden_gate_passed", None), ("remote_forbidden_asr_audio_candidate_gate_passed_sessions", "true", "$.remote_forbidden_asr_audio_candidate_gate_passed", None)]
    out += [(f"remote_forbidden_{c}", "sum", f"$.remote_forbidden_{c}", None) for c in FORBIDDEN_COUNTS]
    out += [(f"remote_forbidden_{c}", "seconds", f"$.remote_forbidden_{c}", None) for c in FORBIDDEN_SECONDS]
    out += [("total_synthesis_review_items", "sum", "$.synthesis_review_item_count", None), ("total_synthesis_review_seconds", "seconds", "$.synthesis_review_item_seconds", None), ("sessions_with_risk_flags", "some", "$.risk_flags", None)]
    return out


def corpus_report(documents: DataFrame, by: list[str], key: str, measures: list[tuple[str, str, str, str | None]] | None = None, first: int = 10) -> DataFrame:
    """by, measure, item, value: all measures over documents(by, key, doc), doc a VARIANT.

    item is null, but for counts by_verdict and by_selected_profile (what is counted; without one: missing) and
    top_risk_sessions (the first sessions with risk flags, by key; value is their place). Missing figures count as 0, null
    documents as empty, and the median is null without durations. total_duration_min and median_duration_min are in minutes.
    """
    spark = documents.sparkSession
    table = spark.createDataFrame(measures or corpus_measures(), MEASURE)  # a row for each measure
    each = documents.select(*by, "doc").join(F.broadcast(table))
    number, json = F.try_variant_get("doc", F.col("path"), "double"), F.coalesce(_json("doc", "path"), F.lit("null"))
    text = F.try_variant_get("doc", F.col("path"), "string")
    value = F.when(F.col("kind") == "rows", 1.0).when(F.col("kind") == "sum", F.coalesce(F.floor(F.abs(number)) * F.signum(number), F.lit(0.0))).when(F.col("kind") == "seconds", F.coalesce(number, F.lit(0.0)))
    equal = F.coalesce(text == F.col("expected"), F.lit(False))
    counted = {"true": json == "true", "present": json != "null", "equal": equal, "differ": ~equal, "some": ~json.isin(*_NOTHING)}
    for kind, condition in counted.items():
        value = value.when(F.col("kind") == kind, condition.cast("double"))
    sums = each.groupBy(*by, "measure", "kind").agg(F.sum(value).alias("value"))
    nothing = F.lit(None).cast("string").alias("item")
    out = sums.select(*by, "measure", nothing, F.when(F.col("kind") == "seconds", F.round("value", 3)).otherwise(F.col("value")).alias("value"))
    flat = documents.select(*by, F.col(key).alias("_key"), F.try_variant_get("doc", "$.meeting_duration_sec", "double").alias("_d"), F.coalesce(F.try_variant_get("doc", "$.verdict", "string"), F.lit("missing")).alias("by_verdict"), F.coalesce(F.try_variant_get("doc", "$.selected_profile", "string"), F.lit("missing")).alias("by_selected_profile"), F.coalesce(F.to_json(F.try_variant_get("doc", "$.risk_flags", "variant")), F.lit("null")).alias("_risk"))
    length = flat.groupBy(*by).agg(F.round(F.coalesce(F.sum("_d"), F.lit(0.0)) / 60, 2).alias("value")).select(*by, F.lit("total_duration_min").alias("measure"), nothing, "value")
    groups = flat.select(*by).distinct()
    middle = percentiles(flat, by, "_d", {"m": 0.5})
    middle = (null_safe(groups, middle, by, "left") if by else middle).select(*by, F.lit("median_duration_min").alias("measure"), nothing, F.round(F.col("m") / 60, 2).alias("value"))
    counts = [flat.groupBy(*by, F.col(c).alias("item")).agg(F.count("*").cast("double").alias("value")).select(*by, F.lit(c).alias("measure"), "item", "value") for c in ("by_verdict", "by_selected_profile")]
    risky = top_per_group(flat.filter(~F.col("_risk").isin(*_NOTHING)), by, [F.col("_key")], first)
    placed = risky.groupBy(*by).agg(F.sort_array(F.collect_list("_key")).alias("_all")).select(*by, F.posexplode("_all").alias("_p", "_k"))  # `first` of a group
    risky = placed.select(*by, F.lit("top_risk_sessions").alias("measure"), F.col("_k").cast("string").alias("item"), (F.col("_p") + 1).cast("double").alias("value"))
    for part in (length, middle, *counts, risky):
        out = out.unionByName(part)
    return out
