"""Queries of session state, gates over artifacts, windows of signals and live rules, each with independent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import intervals as iv
from colloquy.operators import review as rv
from colloquy.operators import sessions as ss
from colloquy.plans.interval_queries import BUCKET
from colloquy.plans.matching_queries import _recall
from colloquy.plans.registry import register
from colloquy.plans.views import INTERVALS_SQL, LIVE_SQL, batch_turns, count, evidence, evidence_sql, flag, intervals, live_turns, pick, share, table

W = f"WITH {INTERVALS_SQL}"


@register("audio_reliable_filter", f"""{W}, r AS (SELECT id, day, s, e, user_id, [user_id % 3, id % 2] AS ids FROM iv WHERE track = 'error'), x AS (SELECT id, day, s, e, unnest(list_distinct(ids)) AS me FROM r), c AS (SELECT x.id, x.me, coalesce(bool_or(g.s IS NOT NULL AND least(x.e, g.e) - greatest(x.s, g.s) >= 0.8 * (x.e - x.s)), FALSE) AS ok FROM x LEFT JOIN (SELECT day, user_id, s - 2400000 AS s, e + 2400000 AS e FROM iv WHERE track = 'view') g ON g.day = x.day AND g.user_id % 3 = x.me AND g.s < x.e AND g.e > x.s GROUP BY ALL)
SELECT id FROM c GROUP BY id HAVING bool_and(ok)""")
def audio_reliable_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows explained for each of their turns by a reliable row of it that covers .80 of them, or is around them if they have no length. Null turns are none."""
    e = intervals(spark, sf_dir)
    rows = e.filter("track = 'error'").withColumn("me_ids", F.array_compact(F.expr("array(user_id % 3, id % 2)")))
    good = e.filter("track = 'view'").withColumn("me_id", F.expr("user_id % 3")).withColumn("start", F.col("start") - 2_400_000).withColumn("end", F.col("end") + 2_400_000)
    return ss.explained_by_reliable(rows.select("day", "id", "start", "end", "me_ids"), good.select("day", "me_id", "start", "end"), ["day"], BUCKET, points=True).select("id")


@register("interval_difference_sec", f"""{W}, edges AS (SELECT day, s AS t, 1 AS a, 0 AS b FROM iv WHERE track = 'purchase' UNION ALL SELECT day, e, -1, 0 FROM iv WHERE track = 'purchase' UNION ALL SELECT day, s, 0, 1 FROM iv WHERE track = 'error' UNION ALL SELECT day, e, 0, -1 FROM iv WHERE track = 'error'), net AS (SELECT day, t, sum(a) AS a, sum(b) AS b FROM edges GROUP BY day, t),
seg AS (SELECT day, t AS s, lead(t) OVER (PARTITION BY day ORDER BY t) AS e, sum(a) OVER (PARTITION BY day ORDER BY t) AS a, sum(b) OVER (PARTITION BY day ORDER BY t) AS b FROM net), p AS (SELECT day, s, e, lag(e) OVER (PARTITION BY day ORDER BY s) AS pe FROM seg WHERE e IS NOT NULL AND a > 0 AND b = 0), q AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY s) AS g FROM p)
SELECT day, round(min(s) / 1000.0, 3) AS "start", round(max(e) / 1000.0, 3) AS "end" FROM q GROUP BY day, g HAVING max(e) - min(s) >= 2500""")
def interval_difference_sec(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = intervals(spark, sf_dir)
    out = iv.difference(e.filter("track = 'purchase'"), e.filter("track = 'error'"), ["day"], least=2500)
    return out.select("day", F.round(F.col("start") / 1000, 3).alias("start"), F.round(F.col("end") / 1000, 3).alias("end"))


@register("rttm_merge_intervals", f"""{W}, o AS (SELECT user_id, s, e, max(e) OVER (PARTITION BY user_id ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv), g AS (SELECT *, sum(CASE WHEN s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT user_id, min(s) AS "start", max(e) AS "end" FROM g GROUP BY user_id, g""")
def rttm_merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.merge(intervals(spark, sf_dir), ["user_id"]).select("user_id", "start", "end")


@register("aec_candidate_rank", "SELECT event_id, rank, rank = 1 AS selected FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS rank FROM events)")
def aec_candidate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a segment by score; the best is selected."""
    rows = table(spark, sf_dir, "events").withColumn("at", -F.col("value")).withColumn("one", F.lit(1))
    ranked = iv.numbered(iv.bucketed(rows, "at", 10), ["user_id", "event_type"], ["at", "event_id"], "one", "rank")
    return ranked.select("event_id", "rank", (F.col("rank") == 1).alias("selected"))


_VAD = {"session": count(7, 40), "remote_db": "-80 + 60 * " + share(11), "mic_db": "-80 + 60 * " + share(13), "reliable": flag(17, 3)}


@register("adaptive_vad_windows", f"""WITH {evidence_sql(_VAD)}, f AS (SELECT session, greatest(quantile_cont(remote_db, 0.2) + 8, -55) AS rt, greatest(quantile_cont(mic_db, 0.2) + 6, -58) AS mt FROM x GROUP BY session)
SELECT id, CASE WHEN remote_db >= rt AND mic_db >= mt AND reliable AND mic_db <= remote_db - 6 THEN 'remote_only' WHEN mic_db >= mt AND remote_db < rt THEN 'local_only' WHEN mic_db >= mt THEN 'double_talk' ELSE 'silence' END AS state FROM x JOIN f USING (session)""")
def adaptive_vad_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of windows by levels against the session's own floors."""
    return ss.vad_states(evidence(spark, sf_dir, _VAD), "session").select("id", "state")


@register("age_filter", """WITH a AS (SELECT event_id, epoch_us(ts) // 1000000 AS ended, CASE event_type WHEN 'click' THEN 1800 WHEN 'view' THEN 86400 WHEN 'error' THEN 604800 WHEN 'signup' THEN 2419200 END AS seconds FROM events) SELECT event_id, seconds, ended + seconds <= (SELECT max(ended) FROM a) AS old FROM a""")
def age_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a session ended at least its age ago, seen from the last end; no age, no answer."""
    kind = F.col("event_type")
    age = rv.ladder("soon", (kind == "click", "30m"), (kind == "view", "24h"), (kind == "error", "7d"), (kind == "signup", "4w"))
    e = table(spark, sf_dir, "events").select("event_id", rv.age_seconds(age).alias("seconds"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ended"))
    now = e.agg(F.max("ended").alias("now"))
    return e.join(F.broadcast(now)).select("event_id", "seconds", (F.col("ended") + F.col("seconds") <= F.col("now")).alias("old"))


_ECHO = {"track": pick(7, "mic", "mic", "remote"), "local_only": share(11), "remote_only": share(13), "double_talk": share(17) + " * 0.5"}


@register("echo_class", f"""WITH {evidence_sql(_ECHO)} SELECT id, CASE WHEN track = 'remote' THEN 'remote_track' WHEN local_only >= 0.55 THEN 'local' WHEN remote_only >= 0.55 THEN 'remote' WHEN double_talk >= 0.25 THEN 'double' ELSE 'uncertain' END AS echo_class FROM x""")
def echo_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.echo_class(evidence(spark, sf_dir, _ECHO)).select("id", "echo_class")


_RETAIN = {"policy": pick(7, "delete", "keep", "delete", None), "export": pick(11, "success", "failed", None), "present": "NOT (" + flag(13, 5) + ")"}


@register("retention_plan", f"WITH {evidence_sql(_RETAIN)} SELECT id, CASE WHEN present AND policy = 'delete' AND export = 'success' THEN 'delete' ELSE 'keep' END AS action FROM x")
def retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.retention(evidence(spark, sf_dir, _RETAIN)).select("id", "action")


_GATE = {"transcript": flag(7, 2), "notes": "NOT (" + flag(11, 6) + ")", "readiness": "NOT (" + flag(13, 7) + ")", "outcome": pick(17, "ready_for_notes", "ready_for_notes", "review_first", None), "export": pick(19, "allowed", "allowed", "blocked"), "pipeline": pick(23, "complete", "complete", "running"), "verdict": pick(29, "good", "good", "risky", "usable_with_review", None)}


@register("export_gate", f"""WITH {evidence_sql(_GATE)} SELECT id, list_filter([CASE WHEN NOT transcript THEN 'missing:transcript_md' END, CASE WHEN NOT notes THEN 'missing:notes_md' END, CASE WHEN NOT readiness THEN 'missing_session_readiness_json' END, CASE WHEN outcome IS NULL THEN 'missing_outcome_json' WHEN outcome <> 'ready_for_notes' THEN 'outcome:' || outcome END,
 CASE WHEN outcome IS NOT NULL AND export <> 'allowed' THEN 'outcome_export:' || export END, CASE WHEN pipeline <> 'complete' THEN 'pipeline_not_complete' END, CASE WHEN verdict IS NULL THEN 'missing_quality_verdict_json' WHEN verdict IN ('failed', 'risky') THEN 'quality_verdict:' || verdict END], lambda b: b IS NOT NULL) AS blockers FROM x""")
def export_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.export_blockers(evidence(spark, sf_dir, _GATE)).select("id", "blockers")


_AGREE = {"profile_a": pick(7, "v1", "v1", None), "profile_b": pick(11, "v1", "v2", "v1", None), "rows_a": count(13, 3), "rows_b": count(17, 3), "seconds_a": "10 * " + share(19, 3), "seconds_b": "10 * " + share(19, 3) + " + 0.002 * (" + count(23, 2) + ")", "current": "NOT (" + flag(29, 4) + ")"}


@register("reconcile", f"""WITH {evidence_sql(_AGREE)} SELECT id, profile_a IS NULL OR profile_b IS NULL OR profile_a = profile_b AS profile_agrees, rows_a = rows_b AS rows_agree, abs(seconds_a - seconds_b) <= 0.001 AS seconds_agree, (profile_a IS NULL OR profile_b IS NULL OR profile_a = profile_b) AND rows_a = rows_b AND abs(seconds_a - seconds_b) <= 0.001 AND current AS passed FROM x""")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two records of a session's state agree on profile, rows and seconds, and its selection is current."""
    return ss.reconcile(evidence(spark, sf_dir, _AGREE)).select("id", "profile_agrees", "rows_agree", "seconds_agree", "passed")


_OUT = {"readiness": pick(7, "ready_for_notes", "review_first", None), "burden": share(11) + " * 0.1", "profile_ok": "NOT (" + flag(13, 8) + ")", "export_blockers": count(17, 3)}


@register("outcome_gates", f"""WITH {evidence_sql(_OUT)} SELECT id, 'readiness_present' AS gate, CASE WHEN readiness IS NULL THEN 'fail' ELSE 'pass' END AS status, 'hard' AS severity FROM x UNION ALL SELECT id, 'profile_current', CASE WHEN profile_ok THEN 'pass' ELSE 'fail' END, 'hard' FROM x WHERE readiness IS NOT NULL
 UNION ALL SELECT id, 'ready_for_notes', CASE WHEN readiness = 'ready_for_notes' THEN 'pass' ELSE 'fail' END, 'hard' FROM x WHERE readiness IS NOT NULL UNION ALL SELECT id, 'review_burden', CASE WHEN burden <= 0.025 THEN 'pass' ELSE 'fail' END, 'soft' FROM x WHERE readiness IS NOT NULL UNION ALL SELECT id, 'export_allowed', CASE WHEN export_blockers = 0 THEN 'pass' ELSE 'fail' END, 'export' FROM x WHERE readiness IS NOT NULL""")
def outcome_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each gate of a session; without readiness only that one."""
    return ss.outcome_gates(evidence(spark, sf_dir, _OUT)).select("id", "gate", "status", "severity")


_QUIET = {"utterances": count(7, 2), "capture_ok": "NOT (" + flag(11, 5) + ")", "mic_silent": "NOT (" + flag(13, 4) + ")", "remote_silent": "NOT (" + flag(17, 4) + ")", "asr_complete": "NOT (" + flag(19, 6) + ")"}


@register("no_speech_proof", f"""WITH {evidence_sql(_QUIET)} SELECT id, CASE WHEN utterances > 0 THEN 'not_applicable' WHEN capture_ok AND mic_silent AND remote_silent AND asr_complete THEN 'verified_no_speech' ELSE 'unproven' END AS status FROM x""")
def no_speech_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.no_speech(evidence(spark, sf_dir, _QUIET), ["capture_ok", "mic_silent", "remote_silent", "asr_complete"]).select("id", "status")


_COMPACT = {"pipeline": pick(7, "complete", "running", "complete"), "raw_kept": "NOT (" + flag(11, 7) + ")", "exported": "NOT (" + flag(13, 3) + ")", "pinned": flag(17, 6), "locked": flag(19, 9), "bytes": count(23, 500)}


@register("compaction_manifest", f"""WITH {evidence_sql(_COMPACT)}, b AS (SELECT *, list_filter([CASE WHEN pipeline <> 'complete' THEN 'pipeline_not_complete' END, CASE WHEN NOT raw_kept THEN 'raw_missing' END, CASE WHEN NOT exported THEN 'not_exported' END, CASE WHEN pinned THEN 'pinned' END, CASE WHEN locked THEN 'locked' END], lambda r: r IS NOT NULL) AS blockers FROM x)
SELECT id, blockers, len(blockers) = 0 AS eligible, CASE WHEN len(blockers) = 0 THEN bytes ELSE 0 END AS reclaim FROM b""")
def compaction_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.compaction(evidence(spark, sf_dir, _COMPACT)).select("id", "blockers", "eligible", "reclaim")


_SPEAK = {"selected": "NOT (" + flag(7, 4) + ")", "version": pick(11, "v3", "v2", "v3"), "transcript_hash": count(13, 2), "expected_hash": count(17, 2), "policy_ok": "NOT (" + flag(19, 5) + ")"}


@register("speaker_selection", f"""WITH {evidence_sql(_SPEAK)}, b AS (SELECT *, list_filter([CASE WHEN NOT selected THEN 'not_selected' END, CASE WHEN transcript_hash <> expected_hash THEN 'stale_transcript' END, CASE WHEN NOT policy_ok THEN 'stale_policy' END], lambda r: r IS NOT NULL) AS reasons FROM x) SELECT id, reasons, CASE WHEN len(reasons) = 0 AND version = 'v3' THEN 'speaker_resolved' ELSE 'base' END AS transcript FROM b""")
def speaker_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.speaker_selection(evidence(spark, sf_dir, _SPEAK)).select("id", "reasons", "transcript")


@register("role_gate", f"""WITH {LIVE_SQL} SELECT a.session, a.id, len(a.tokens) >= 3 AND len(b.tokens) >= 3 AND greatest({_recall("a.tokens", "b.tokens")}, {_recall("b.tokens", "a.tokens")}) >= 0.55 AS suppressed FROM live a JOIN batch b ON b.session = a.session AND b.id = a.id + 1000 WHERE a.role = 'Me'""")
def role_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mic chunk goes if it and the remote one, three words each, hold .55 of the other's words in either direction."""
    other = batch_turns(spark, sf_dir).select("session", (F.col("id") - 1000).alias("id"), F.col("tokens").alias("far"))
    rows = live_turns(spark, sf_dir).filter("role = 'Me'").join(other, ["session", "id"])
    return rows.select("session", "id", ss.role_gate(F.col("tokens"), F.col("far")).alias("suppressed"))


@register("end_of_stream", "WITH s AS (SELECT conv_id, turn, role IN ('user') AS mic, turn % 9 <> 8 AS done FROM conversations), f AS (SELECT conv_id, max(turn) AS last, bool_and(done) AS all_done, bool_or(mic) AND bool_or(NOT mic) AS sides, count(DISTINCT turn) AS n, min(turn) AS first FROM s GROUP BY conv_id) SELECT conv_id, all_done AND sides AND n = last - first + 1 AS complete FROM f")
def end_of_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides are there and every index up to the last is processed."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("index"), (F.col("role") == "user").alias("mic"), (F.col("turn") % 9 != 8).alias("processed"))
    return ss.stream_complete(c, "conv_id")


@register("window_chunks", """WITH f AS (SELECT vec_id, 480000 + vec_id * 1013 AS frames FROM embeddings), w AS (SELECT vec_id, frames, unnest(range(0, CAST(ceil(frames / 160000.0) AS BIGINT))) AS i FROM f) SELECT vec_id, i AS index, i * 160000 AS hard_start, least(i * 160000 + 160000, frames) AS hard_end, greatest(i * 160000 - 16000, 0) AS clip_start, least(least(i * 160000 + 160000, frames) + 16000, frames) AS clip_end FROM w""")
def window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-second windows of a signal in frames, padded by a second for decoding."""
    frames = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(0).cast("long").alias("start"), (480_000 + F.col("vec_id") * 1013).cast("long").alias("end"))
    return iv.tumbling(frames, ["vec_id"], 160_000, 16_000)


@register("nearest_run_join", f"""{W}, m AS (SELECT day, id, s, e - s < 10000 AS quiet, row_number() OVER (PARTITION BY day ORDER BY s, id) - row_number() OVER (PARTITION BY day, e - s < 10000 ORDER BY s, id) AS g FROM iv), r AS (SELECT day, min(s) AS first, max(s) AS last FROM m WHERE quiet GROUP BY day, g HAVING count(*) >= 2),
p AS (SELECT id, day, s FROM iv WHERE track = 'purchase'), n AS (SELECT p.id, first, last - first AS length, CASE WHEN s BETWEEN first AND last THEN 0 ELSE least(abs(s - first), abs(s - last)) END AS d FROM p JOIN r USING (day) WHERE first <= s + 600000 AND last >= s - 600000) SELECT id, first, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, length DESC, first) AS k FROM n) WHERE k = 1""")
def nearest_run_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quiet run nearest to a point within ten minutes; of equally near ones the longest."""
    e = intervals(spark, sf_dir)
    quiet = iv.runs(e.withColumn("quiet", F.col("end") - F.col("start") < 10_000), ["day"], ["start", "id"], "quiet").filter("quiet and n >= 2")
    return ss.nearest_run(e.filter("track = 'purchase'").select("day", "id", F.col("start").alias("at")), quiet.select("day", "first", "last"), ["day"], 600_000).select("id", "first", "d")


@register("nearest_tolerance_join", f"""{W}, g AS (SELECT id, day, s, s + 3000 AS e FROM iv WHERE track = 'purchase'), r AS (SELECT day, s AS m FROM iv WHERE track IN ('click', 'view')), n AS (SELECT g.id, r.m, CASE WHEN m BETWEEN g.s AND g.e THEN 0 ELSE least(abs(m - g.s), abs(m - g.e)) END AS d, g.s FROM g JOIN r USING (day))
SELECT id, m AS restart, d AS distance, CASE WHEN m < s THEN 'before' ELSE 'after' END AS side FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, m) AS k FROM n) WHERE k = 1 AND d <= 60000""")
def nearest_tolerance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The restart nearest to either end of a gap, 0 inside it; none beyond a minute."""
    e = intervals(spark, sf_dir)
    gaps = e.filter("track = 'purchase'").select("day", "id", "start", (F.col("start") + 3000).alias("end"))
    return ss.nearest_restart(gaps, e.filter(F.col("track").isin("click", "view")).select("day", F.col("start").alias("at")), ["day"], 60_000)


@register("running_pareto", """WITH e AS (SELECT event_id, user_id AS risk, value AS gain, event_id * 37 % 101 AS precision FROM events), o AS (SELECT *, max(gain) OVER w AS g, max(precision) OVER w AS p FROM e WINDOW w AS (ORDER BY risk, gain DESC, precision DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT event_id FROM o WHERE g IS NULL OR gain > g OR precision > p""")
def running_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules in order of risk whose gain or precision beats all before them."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("risk"), F.col("value").alias("gain"), F.expr("event_id * 37 % 101").alias("precision"))
    return ss.pareto(e, "risk", ["gain", "precision"], "event_id").select("event_id")


@register("renumber", "SELECT event_id, 'utt_' || lpad(CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS VARCHAR), 6, '0') AS id FROM events")
def renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.lit(1).alias("one"))
    out = iv.numbered(iv.bucketed(rows, "at"), ["user_id"], ["ts", "event_id"], "one", "place")
    return out.select("event_id", F.concat(F.lit("utt_"), F.lpad(F.col("place").cast("string"), 6, "0")).alias("id"))


@register("cross_role_overlap_join", f"""{W}, p AS (SELECT a.id AS left_id, b.id AS right_id, least(a.e, b.e) - greatest(a.s, b.s) AS overlap_ms, (a.user_id * b.user_id) % 100 / 100.0 AS sim, a.id % 6 = 0 OR b.id % 6 = 0 AS doubt FROM iv a JOIN iv b ON a.track <> b.track AND (a.s < b.s OR a.s = b.s AND a.id < b.id) AND a.s < b.e AND a.e > b.s)
SELECT left_id, right_id, overlap_ms, CASE WHEN overlap_ms <= 2000 THEN 'short_overlap' WHEN sim > 0.65 THEN 'probable_duplicate_unresolved' WHEN doubt THEN 'uncertain' ELSE 'double_talk' END AS type FROM p""")
def cross_role_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps between tracks with their kinds: short, of like text, in doubt, or double talk."""
    rows = intervals(spark, sf_dir)
    pairs = iv.overlap_join(rows, rows, [], BUCKET)
    first = (F.col("l.start") < F.col("r.start")) | ((F.col("l.start") == F.col("r.start")) & (F.col("l.id") < F.col("r.id")))
    shared = iv.overlap(F.col("l.start"), F.col("l.end"), F.col("r.start"), F.col("r.end"))
    similar, doubt = (F.col("l.user_id") * F.col("r.user_id")) % 100 / 100.0, (F.col("l.id") % 6 == 0) | (F.col("r.id") % 6 == 0)
    return pairs.filter((F.col("l.track") != F.col("r.track")) & first).select(F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"), shared.alias("overlap_ms"), ss.overlap_type(shared, similar, doubt).alias("type"))


@register("dialogue_overlap_metrics", f"""{W}, p AS (SELECT m.id, sum(least(m.e, r.e) - greatest(m.s, r.s)) AS ms FROM iv m JOIN iv r ON m.track = 'error' AND r.track = 'view' AND m.s < r.e AND m.e > r.s GROUP BY m.id) SELECT id, CAST(ms AS BIGINT) AS overlap_ms, ms > 1000 AS counted FROM p""")
def dialogue_overlap_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long the other side speaks during each mic row, and whether that is more than a second."""
    e = intervals(spark, sf_dir)
    pairs = iv.overlap_join(e.filter("track = 'error'"), e.filter("track = 'view'"), [], BUCKET)
    ms = F.sum(iv.overlap(F.col("l.start"), F.col("l.end"), F.col("r.start"), F.col("r.end")))
    return pairs.groupBy(F.col("l.id").alias("id")).agg(ms.alias("overlap_ms")).withColumn("counted", F.col("overlap_ms") > 1000)

