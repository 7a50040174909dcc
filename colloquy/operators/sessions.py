"""State of sessions: gates over artifacts, signal windows, nearest runs and restarts, live rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators import intervals as iv
from colloquy.operators.decisions import label, num, yes
from colloquy.operators.evaluation import percentiles
from colloquy.operators.matching import recall
from colloquy.operators.review import flags, ladder
from colloquy.storage import materialize


def explained_by_reliable(rows: DataFrame, reliable: DataFrame, by: list[str], width: int, points: bool = False) -> DataFrame:
    """rows(by, id, start, end, me_ids) each of whose me_ids has a reliable row(by, me_id, start, end) over .80 of it; without ids it isn't explained.

    A row without length isn't either; with `points` it is by a reliable row that begins before and ends after it. Rows of equal
    ids are one row of several parts: a me_id is covered if it is in one of them.

    Of the reliable rows that begin no later than a row the one that ends last covers most of it, and of those that end no
    earlier the one that begins first: both are running values in buckets of time. Only reliable rows that lie inside of a row,
    in none as long, are joined with it.
    """
    keys = [*by, "me_id"]
    known = F.col("start").isNotNull() & F.col("end").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    every = rows.withColumn("me_id", F.explode(F.array_distinct("me_ids"))).select(*keys, "id", "start", "end")
    fits = known & (F.col("end") >= F.col("start") if points else F.col("end") > F.col("start"))
    each = every.filter(fits)
    never = every.filter(~F.coalesce(fits, F.lit(False))).select("me_id", "id", F.lit(False).alias("_ok"))
    good = reliable.filter(known).select(*keys, "start", "end")
    enough = 0.80 * (F.col("end") - F.col("start"))

    def beside(rows: DataFrame, at: str, value: str) -> DataFrame:
        """rows and good together, with good's value; at equal times good comes before rows, but after those without length."""
        own = rows.withColumn("_side", F.when(F.col("end") > F.col("start"), 1).otherwise(-1)).withColumn("_v", F.lit(None).cast(good.schema[value].dataType))
        return iv.bucketed(own.unionByName(good.withColumn("_side", F.lit(0)).withColumn("_v", F.col(value)), allowMissingColumns=True), at)

    w = Window.partitionBy(*keys, "_k")
    told = iv.with_carry(beside(each, "start", "end"), keys, {"_before": (F.max("_v"), F.max)})
    reach = F.greatest(F.max("_v").over(w.orderBy("start", "_side").rowsBetween(Window.unboundedPreceding, 0)), F.col("_before"))
    told = told.withColumn("_reach", reach).filter("_side <> 0").select(*each.columns, F.coalesce((F.least("end", "_reach") - F.col("start") >= enough) & (F.col("_reach") > F.col("start")), F.lit(False)).alias("_left"))
    told = iv.with_carry(beside(told, "end", "start"), keys, after={"_after": (F.min("_v"), F.min)})
    since = F.least(F.min("_v").over(w.orderBy(F.desc("end"), "_side").rowsBetween(Window.unboundedPreceding, 0)), F.col("_after"))
    told = told.withColumn("_since", since).filter("_side <> 0").select(*each.columns, (F.col("_left") | F.coalesce((F.col("end") - F.greatest("start", "_since") >= enough) & (F.col("_since") < F.col("end")), F.lit(False))).alias("_ok"))
    told = materialize(told, "told")
    longest = each.groupBy(*keys).agg(F.max(F.col("end") - F.col("start")).alias("_longest"))
    short = good.join(longest, keys).filter((F.col("end") > F.col("start")) & (F.col("end") - F.col("start") < F.col("_longest"))).drop("_longest").distinct()
    length = F.col("r.end") - F.col("r.start")
    inside = iv.overlap_join(told.filter("not _ok").select(*keys, "id", "start", "end"), short, keys, width).filter((F.col("r.start") > F.col("l.start")) & (F.col("r.end") < F.col("l.end")) & (length >= 0.80 * (F.col("l.end") - F.col("l.start"))))
    ok = told.select("me_id", "id", "_ok").unionAll(inside.select("me_id", F.col("l.id").alias("id"), F.lit(True).alias("_ok"))).unionAll(never).groupBy("me_id", "id").agg(F.bool_or("_ok").alias("_ok"))
    return ok.groupBy("id").agg(F.bool_and("_ok").alias("_all")).filter("_all").select("id")


def vad_states(windows: DataFrame, by: str, remote_margin: float = 8.0, mic_margin: float = 6.0, least_remote: float = -55.0, least_mic: float = -58.0, gap: float = 6.0) -> DataFrame:
    """windows(remote_db, mic_db, reliable) with `state`, by thresholds over the 20th percentiles of the key's own levels."""
    floors = percentiles(windows, [by], "remote_db", {"_r": 0.2}).join(percentiles(windows, [by], "mic_db", {"_m": 0.2}), by)
    out = windows.join(floors, by)
    remote = F.col("remote_db") >= F.greatest(F.col("_r") + remote_margin, F.lit(least_remote))
    mic = F.col("mic_db") >= F.greatest(F.col("_m") + mic_margin, F.lit(least_mic))
    state = ladder("silence", (remote & mic & yes("reliable") & (F.col("mic_db") <= F.col("remote_db") - gap), "remote_only"), (mic & ~remote, "local_only"), (mic & remote, "double_talk"))
    return out.withColumn("state", state).drop("_r", "_m")


def echo_class(rows: DataFrame) -> DataFrame:
    """echo_class by the shares of speaker states under a turn; remote turns are of their own class."""
    kind = ladder("uncertain", (label("track") == "remote", "remote_track"), (num("local_only") >= 0.55, "local"), (num("remote_only") >= 0.55, "remote"), (num("double_talk") >= 0.25, "double"))
    return rows.withColumn("echo_class", kind)


def retention(rows: DataFrame) -> DataFrame:
    """action: delete only what is there, if the policy says so and the export succeeded."""
    return rows.withColumn("action", ladder("keep", (yes("present") & (label("policy") == "delete") & (label("export") == "success"), "delete")))


def export_blockers(rows: DataFrame) -> DataFrame:
    """blockers of an export in the order of the checks: files, readiness, outcome, pipeline, verdict. A null outcome or verdict is a missing file."""
    named = [
        F.when(~yes("transcript"), F.lit("missing:transcript_md")),
        F.when(~yes("notes"), F.lit("missing:notes_md")),
        F.when(~yes("readiness"), F.lit("missing_session_readiness_json")),
        F.when(F.col("outcome").isNull(), F.lit("missing_outcome_json")).when(F.col("outcome") != "ready_for_notes", F.concat(F.lit("outcome:"), F.col("outcome"))),
        F.when(F.col("outcome").isNotNull() & (label("export") != "allowed"), F.concat(F.lit("outcome_export:"), F.coalesce("export", F.lit("unknown")))),
        F.when(label("pipeline") != "complete", F.lit("pipeline_not_complete")),
        F.when(F.col("verdict").isNull(), F.lit("missing_quality_verdict_json")).when(F.col("verdict").isin("failed", "risky"), F.concat(F.lit("quality_verdict:"), F.col("verdict"))),
    ]
    return rows.withColumn("blockers", F.array_compact(F.array(*named)))


def reconcile(rows: DataFrame) -> DataFrame:
    """profile_agrees (at most one that isn't empty), rows_agree, seconds_agree (to a millisecond) and passed, which needs a current selection as well."""
    a, b = F.nullif(F.col("profile_a"), F.lit("")), F.nullif(F.col("profile_b"), F.lit(""))
    checks = [F.coalesce(a == b, F.lit(True)), num("rows_a") == num("rows_b"), F.abs(num("seconds_a") - num("seconds_b")) <= 0.001]
    return rows.select("*", *[c.alias(n) for c, n in zip(checks, ("profile_agrees", "rows_agree", "seconds_agree"), strict=True)], (checks[0] & checks[1] & checks[2] & yes("current")).alias("passed"))


def outcome_gates(rows: DataFrame) -> DataFrame:
    """A row (gate, status, severity) for each gate; where readiness is missing the first fails and the others aren't looked at."""
    there = F.col("readiness").isNotNull()
    gates = [("readiness_present", there, "hard"), ("profile_current", yes("profile_ok"), "hard"), ("ready_for_notes", label("readiness") == "ready_for_notes", "hard"), ("review_burden", num("burden") <= 0.025, "soft"), ("export_allowed", num("export_blockers") == 0, "export")]
    made = [F.struct(F.lit(n).alias("gate"), F.when(ok, "pass").otherwise("fail").alias("status"), F.lit(s).alias("severity")) for n, ok, s in gates]
    return rows.select("*", F.explode(F.when(there, F.array(*made)).otherwise(F.array(made[0]))).alias("_g")).select(*rows.columns, "_g.*")


def no_speech(rows: DataFrame, checks: list[str]) -> DataFrame:
    """status: a session without utterances is proven silent if all checks pass."""
    proven = F.lit(True)
    for c in checks:
        proven = proven & yes(c)
    return rows.withColumn("status", ladder("unproven", (num("utterances") > 0, "not_applicable"), (proven, "verified_no_speech")))


def compaction(rows: DataFrame) -> DataFrame:
    """blockers, eligible and the bytes that compaction would reclaim."""
    named = flags(("pipeline_not_complete", label("pipeline") != "complete"), ("raw_missing", ~yes("raw_kept")), ("not_exported", ~yes("exported")), ("pinned", yes("pinned")), ("locked", yes("locked")))
    out = rows.withColumn("blockers", named).withColumn("eligible", F.size("blockers") == 0)
    return out.withColumn("reclaim", F.when(F.col("eligible"), F.col("bytes")).otherwise(0))


def speaker_selection(rows: DataFrame) -> DataFrame:
    """reasons against a speaker-resolved transcript, and which transcript counts: only a selected, fresh one of version 3."""
    out = rows.withColumn("reasons", flags(("not_selected", ~yes("selected")), ("stale_transcript", F.col("transcript_hash") != F.col("expected_hash")), ("stale_policy", ~yes("policy_ok"))))
    return out.withColumn("transcript", F.when((F.size("reasons") == 0) & (label("version") == "v3"), "speaker_resolved").otherwise("base"))


def role_gate(mic: Column, remote: Column, least: float = 0.55) -> Column:
    """Whether a mic chunk repeats the remote one: both have three words, and one holds enough of the other's."""
    return (F.size(mic) >= 3) & (F.size(remote) >= 3) & (F.greatest(recall(mic, remote), recall(remote, mic)) >= least)


def stream_complete(rows: DataFrame, by: str) -> DataFrame:
    """by, complete: both sides of rows(index, mic, processed) are there, without a gap in the index, and all are processed."""
    out = rows.groupBy(by).agg(F.bool_and("processed").alias("_p"), (F.bool_or("mic") & F.bool_or(~F.col("mic"))).alias("_b"), (F.countDistinct("index") == F.max("index") - F.min("index") + 1).alias("_n"))
    return out.select(by, (F.col("_p") & F.col("_b") & F.col("_n")).alias("complete"))


def nearest_run(points: DataFrame, runs: DataFrame, by: list[str], reach: int) -> DataFrame:
    """points(by, id, at) with the nearest of runs(by, first, last) within reach: first and distance d, 0 inside; ties: longer, then earlier.

    A point meets the runs that it lies in, of which only those outside of all others count, and the last one to end before
    it and the first one to begin behind it, which are running values in buckets of time.
    """
    keyed = F.lit(True)
    for k in by:
        keyed = keyed & F.col(k).isNotNull()
    runs = runs.filter(keyed & (F.col("last") >= F.col("first"))).select(*by, "first", "last")
    points = points.filter(keyed & F.col("at").isNotNull()).select(*by, "id", "at")
    # of runs that begin together the longest, and of these only what ends later than all that began before
    heads = iv.with_carry(iv.bucketed(runs.groupBy(*by, "first").agg(F.max("last").alias("last")), "first"), by, {"_reach": (F.max("last"), F.max)})
    w = Window.partitionBy(*by, "_k")
    earlier = F.greatest(F.max("last").over(w.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.col("_reach"))
    outer = heads.withColumn("_r", earlier).filter(F.col("_r").isNull() | (F.col("last") > F.col("_r"))).select(*by, "first", "last")
    inside = iv.overlap_join(points.select("*", F.col("at").alias("start"), (F.col("at") + 1).alias("end")), outer.select(*by, F.col("first").alias("start"), (F.col("last") + 1).alias("end")), by, max(reach, 1))
    inside = inside.select(F.col("l.id").alias("id"), F.lit(0).cast("long").alias("d"), F.col("r.start").alias("first"), (F.col("r.end") - 1).alias("last"))
    both = points.withColumn("_side", F.lit(1)).unionByName(outer.select(*by, F.col("first").alias("at"), "first", "last", F.lit(0).alias("_side")), allowMissingColumns=True)
    ends, begins = (F.when(F.col("_side") == 0, F.struct(*c)) for c in (("last", "first"), ("first", "last")))
    both = iv.with_carry(iv.bucketed(both, "at"), by, {"_b": (F.max(ends), F.max)}, {"_a": (F.min(begins), F.min)})
    so_far = (Window.unboundedPreceding, 0)
    before = F.greatest(F.max(ends).over(w.orderBy("at", "_side").rowsBetween(*so_far)), F.col("_b"))
    after = F.least(F.min(begins).over(w.orderBy(F.desc("at"), F.desc("_side")).rowsBetween(*so_far)), F.col("_a"))
    near = both.withColumn("_before", before).withColumn("_after", after).filter("_side = 1")
    found = [near.select("id", F.greatest(d, F.lit(0)).alias("d"), f"{n}.first", f"{n}.last") for n, d in (("_before", F.col("at") - F.col("_before.last")), ("_after", F.col("_after.first") - F.col("at")))]
    close = found[0].unionByName(found[1]).filter(F.col("first").isNotNull() & (F.col("d") <= reach)).unionByName(inside)
    best = close.groupBy("id").agg(F.min(F.struct("d", (F.col("first") - F.col("last")).alias("n"), "first")).alias("b"))
    return best.select("id", "b.first", "b.d")


def nearest_restart(gaps: DataFrame, restarts: DataFrame, by: list[str], reach: int) -> DataFrame:
    """id, restart, distance, side of gaps(by, id, start, end): the restart(by, at) nearest to an end, 0 inside; ties: earlier. None beyond the reach."""
    wide = gaps.select(*by, "id", F.col("start").alias("s"), F.col("end").alias("e"), (F.col("start") - reach).alias("start"), (F.col("end") + reach + 1).alias("end"))
    pairs = iv.overlap_join(wide, restarts.select(*by, F.col("at").alias("start"), (F.col("at") + 1).alias("end")), by, max(reach, 1))
    at, s, e = F.col("r.start"), F.col("l.s"), F.col("l.e")
    d = F.when((at >= s) & (at <= e), 0).otherwise(F.least(F.abs(at - s), F.abs(at - e)))
    best = pairs.groupBy(F.col("l.id").alias("id")).agg(F.min(F.struct(d.alias("d"), at.alias("at"), s.alias("s"))).alias("b"))
    return best.select("id", F.col("b.at").alias("restart"), F.col("b.d").alias("distance"), F.when(F.col("b.at") < F.col("b.s"), "before").otherwise("after").alias("side"))


def pareto(rows: DataFrame, risk: str, gains: list[str], key: str, parts: int = 256) -> DataFrame:
    """rows that beat, in one of the gains, all rows of less risk, and those of their risk with more gain (ties: by key). A null risk comes first, null gains beat nothing.

    Risks are cut at quantiles into ranges of about as many rows, and a risk with many rows into ranges of its first gain.
    The best of earlier ranges is carried over the short table of ranges, and windows run inside a range.
    """
    cuts = rows.agg(F.percentile_approx(F.struct(risk).getField(risk), [k / parts for k in range(1, parts)], 10_000)).first()[0] or []  # at most `parts` numbers
    edges = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    ranges = F.coalesce(F.size(F.filter(edges, lambda e: e <= F.col(risk))), F.lit(-1))
    best = {f"_g{i}": (F.max(g), F.max) for i, g in enumerate(gains)}
    out = rows.withColumn("_k", ranges)
    per = out.groupBy("_k").agg(*[a.alias(n) for n, (a, _) in best.items()])
    before = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)  # over `parts` + 1 rows
    carried = per.select("_k", *[F.max(n).over(before).alias(n) for n in best])
    out = out.join(F.broadcast(carried), "_k")
    # inside a range, risks that are equal to its upper end may be many: of each risk only rows that beat its own earlier risks matter
    w = Window.partitionBy("_k").orderBy(F.asc_nulls_first(risk), *[F.desc_nulls_last(g) for g in gains], key).rowsBetween(Window.unboundedPreceding, -1)
    better = F.lit(False)
    for i, g in enumerate(gains):
        bar = F.greatest(F.max(g).over(w), F.col(f"_g{i}"))
        better = better | F.coalesce(F.col(g) > bar, F.col(g).isNotNull() & bar.isNull())
    return out.withColumn("_better", better).filter("_better").select(*rows.columns)


def overlap_type(shared: Column, similarity: Column, doubt: Column) -> Column:
    """Kind of an overlap of two roles: two seconds at most are short, then like texts, then rows in doubt, else double talk."""
    return ladder("double_talk", (shared <= 2000, "short_overlap"), (similarity > 0.65, "probable_duplicate_unresolved"), (doubt, "uncertain"))
