"""Queries of best matches, parity and folds. Those without SQL rest on sequence ratios or ordered folds; tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions import strings as st
from colloquy.operators import chronology, folds
from colloquy.operators import matching as mt
from colloquy.operators import review as rv
from colloquy.operators.joins import dealt
from colloquy.plans.registry import register
from colloquy.plans.views import LIVE_SQL, batch_turns, intervals, live_turns

W = f"WITH {LIVE_SQL}"
TERMS = ["the", "lake", "road", "haus", "maison", "tren"]


def _recall(a: str, b: str) -> str:
    shared = f"list_sum(list_transform(list_distinct({a}), lambda t: least(len(list_filter({a}, lambda x: x = t)), len(list_filter({b}, lambda y: y = t)))))"
    return f"CASE WHEN len({a}) = 0 THEN 0.0 ELSE CAST(coalesce({shared}, 0) AS DOUBLE) / len({a}) END"


_BEST = f"""{W}, p AS (SELECT a.session, a.id, b.id AS batch_id, b.s AS batch_start, {_recall("a.tokens", "b.tokens")} AS rec, abs(a.s - b.s) AS away, CASE WHEN a.s < b.e AND a.e > b.s THEN 0.15 ELSE 0.0 END + CASE WHEN a.role = b.role THEN 0.1 ELSE 0.0 END
 + CASE WHEN a.content > 3 THEN 0.0 WHEN abs(a.s - b.s) <= 15000 THEN 0.35 WHEN abs(a.s - b.s) <= 45000 THEN 0.15 WHEN abs(a.s - b.s) > 120000 THEN -0.25 ELSE 0.0 END AS extra FROM live a JOIN batch b USING (session) WHERE len(a.tokens) > 0 AND len(b.tokens) > 0),
q AS (SELECT *, round(rec + extra, 6) AS score, round(rec, 6) AS token_recall FROM p), r AS (SELECT *, row_number() OVER w AS r, coalesce(lead(score) OVER w, 0.0) AS second_score, count(*) FILTER (token_recall >= 0.25 AND score >= 0.35) OVER (PARTITION BY session, id) AS plausible FROM q WINDOW w AS (PARTITION BY session, id ORDER BY score DESC, token_recall DESC, away, batch_start, batch_id)),
m AS (SELECT session, id, batch_id, batch_start, score, token_recall, second_score, round(score - second_score, 6) AS margin, plausible, plausible > 1 AND round(score - second_score, 6) < 0.2 AS ambiguous FROM r WHERE r = 1)"""


@register("global_best_match_join", f"{_BEST} SELECT * FROM m")
def global_best_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.best_match(live_turns(spark, sf_dir), batch_turns(spark, sf_dir))


@register("filtered_match_join", f"{_BEST} SELECT session, id, batch_id FROM m WHERE token_recall >= 0.5 AND score >= 0.7")
def filtered_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.matched(live_turns(spark, sf_dir), batch_turns(spark, sf_dir), 0.5, 0.7).select("session", "id", "batch_id")


_LEAK = f"""o AS (SELECT a.session, a.id, any_value(a.tokens) AS tokens, flatten(coalesce(list(b.tokens ORDER BY b.s, b.id) FILTER (b.role = 'Me'), [])) AS own, flatten(coalesce(list(b.tokens ORDER BY b.s, b.id) FILTER (b.role = 'Colleagues'), [])) AS far
 FROM live a LEFT JOIN batch b ON a.session = b.session AND a.s < b.e AND a.e > b.s WHERE a.role = 'Me' AND len(a.tokens) >= 3 GROUP BY ALL),
lk AS (SELECT session, id, round({_recall("tokens", "own")}, 6) AS same_role_recall, round({_recall("tokens", "far")}, 6) AS remote_role_recall FROM o)"""


@register("semi_leak_join", f"{W}, {_LEAK} SELECT * FROM lk WHERE remote_role_recall >= 0.55 AND same_role_recall < 0.35")
def semi_leak_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.leaked(live_turns(spark, sf_dir), batch_turns(spark, sf_dir))


_MISSING = f"""mo AS (SELECT b.session, b.id, any_value(b.tokens) AS tokens, flatten(coalesce(list(a.tokens ORDER BY a.s, a.id) FILTER (a.id IS NOT NULL), [])) AS around FROM batch b LEFT JOIN live a ON a.session = b.session AND a.role = 'Me' AND a.s < b.e AND a.e > b.s WHERE b.role = 'Me' AND len(b.tokens) >= 2 AND NOT b.suspicious GROUP BY ALL),
ms AS (SELECT session, id, round({_recall("tokens", "around")}, 6) AS recall FROM mo)"""


@register("anti_missing_join", f"{W}, {_MISSING} SELECT * FROM ms WHERE recall < 0.35")
def anti_missing_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.missing(batch_turns(spark, sf_dir), live_turns(spark, sf_dir))


@register("anti_covered_by_base", f"""{W}, c AS (SELECT b.session, b.id, a.id AS base_id, row_number() OVER (PARTITION BY b.session, b.id ORDER BY a.s, a.id) AS r FROM batch b JOIN live a USING (session, chunk, role) WHERE b.s < a.e AND b.e > a.s AND least(a.e, b.e) - greatest(a.s, b.s) >= 0.6 * (b.e - b.s) AND {_recall("b.tokens", "a.tokens")} >= 0.8) SELECT session, id, base_id FROM c WHERE r = 1""")
def anti_covered_by_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.covered_by_base(batch_turns(spark, sf_dir), live_turns(spark, sf_dir))


_PARITY = f"""{_BEST}, {_LEAK}, {_MISSING}, k AS (SELECT m.session, batch_start, lag(batch_start) OVER (PARTITION BY m.session ORDER BY l.s, l.e, l.id) AS previous FROM m JOIN live l ON l.session = m.session AND l.id = m.id WHERE token_recall >= 0.25),
f AS (SELECT session, count(*) AS matched, count(*) FILTER (batch_start + 1000 < previous) AS mismatches FROM k GROUP BY session), l1 AS (SELECT session, count(*) AS live_turns FROM live GROUP BY session), b1 AS (SELECT session, count(*) AS batch_turns FROM batch GROUP BY session),
g AS (SELECT session, count(*) AS leaked, sum(e - s) AS leak_ms FROM lk JOIN live USING (session, id) WHERE remote_role_recall >= 0.55 AND same_role_recall < 0.35 GROUP BY session), h AS (SELECT session, count(*) AS missing, sum(e - s) AS missing_ms FROM ms JOIN batch USING (session, id) WHERE recall < 0.35 GROUP BY session),
par AS (SELECT session, live_turns, coalesce(batch_turns, 0) AS batch_turns, coalesce(matched, 0) AS matched, coalesce(mismatches, 0) AS mismatches, coalesce(leaked, 0) AS leaked, CAST(coalesce(leak_ms, 0) AS BIGINT) AS leak_ms, coalesce(missing, 0) AS missing, CAST(coalesce(missing_ms, 0) AS BIGINT) AS missing_ms FROM l1 LEFT JOIN b1 USING (session) LEFT JOIN f USING (session) LEFT JOIN g USING (session) LEFT JOIN h USING (session))"""


@register("parity_metrics", f"{_PARITY} SELECT * FROM par")
def parity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By session: rows of both sides, matches, order mismatches among them, leaked and missing turns with their lengths."""
    live, batch = live_turns(spark, sf_dir), batch_turns(spark, sf_dir)
    found = mt.matched(live, batch).join(live.select("session", "id", "start", "end"), ["session", "id"])
    found = found.withColumn("previous", F.lag("batch_start").over(Window.partitionBy("session").orderBy("start", "end", "id")))
    size = F.sum(F.col("end") - F.col("start"))
    parts = [
        batch.groupBy("session").agg(F.count("*").alias("batch_turns")),
        found.groupBy("session").agg(F.count("*").alias("matched"), F.count_if(F.col("batch_start") + 1000 < F.col("previous")).alias("mismatches")),
        mt.leaked(live, batch).join(live, ["session", "id"]).groupBy("session").agg(F.count("*").alias("leaked"), size.alias("leak_ms")),
        mt.missing(batch, live).join(batch, ["session", "id"]).groupBy("session").agg(F.count("*").alias("missing"), size.alias("missing_ms")),
    ]
    out = live.groupBy("session").agg(F.count("*").alias("live_turns"))
    for part in parts:
        out = out.join(part, "session", "left")
    return out.fillna(0)


@register("parity_gate", f"""{_PARITY} SELECT session, 'coverage' AS id, 'hard' AS severity, CASE WHEN matched >= 0.8 * live_turns THEN 'pass' ELSE 'fail' END AS status, CAST(matched AS DOUBLE) AS observed FROM par UNION ALL SELECT session, 'order', 'hard', CASE WHEN mismatches = 0 THEN 'pass' ELSE 'fail' END, CAST(mismatches AS DOUBLE) FROM par
 UNION ALL SELECT session, 'leak', 'hard', CASE WHEN leak_ms <= 3000 THEN 'pass' ELSE 'fail' END, CAST(leak_ms AS DOUBLE) FROM par UNION ALL SELECT session, 'missing', 'soft', CASE WHEN missing_ms <= 5000 THEN 'pass' ELSE 'fail' END, CAST(missing_ms AS DOUBLE) FROM par""")
def parity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parity_metrics(spark, sf_dir)
    checks = [("coverage", "hard", F.col("matched") >= 0.8 * F.col("live_turns"), F.col("matched")), ("order", "hard", F.col("mismatches") == 0, F.col("mismatches")), ("leak", "hard", F.col("leak_ms") <= 3000, F.col("leak_ms")), ("missing", "soft", F.col("missing_ms") <= 5000, F.col("missing_ms"))]
    return rv.check_rows(p, checks).select("session", "id", "severity", "status", "observed")


@register("inverted_index_anchor_join", f"""{W}, ix AS (SELECT DISTINCT session, id AS local_id, unnest(tokens) AS t FROM batch WHERE role = 'Colleagues'), d AS (SELECT session, t, count(*) AS df FROM ix GROUP BY ALL), o AS (SELECT DISTINCT session, id, unnest(tokens) AS t FROM live WHERE role = 'Me'),
r AS (SELECT session, id, t, row_number() OVER (PARTITION BY session, id ORDER BY df, t) AS k FROM o JOIN d USING (session, t)) SELECT DISTINCT session, id, local_id FROM r JOIN ix USING (session, t) WHERE k <= 3""")
def inverted_index_anchor_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.rare_token_pairs(live_turns(spark, sf_dir).filter("role = 'Me'"), batch_turns(spark, sf_dir).filter("role = 'Colleagues'"))


@register("offset_anchors")
def offset_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.anchors(live_turns(spark, sf_dir), batch_turns(spark, sf_dir), least_words=3, least_score=0.6)


@register("reference_alignment_join")
def reference_alignment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.align(live_turns(spark, sf_dir), batch_turns(spark, sf_dir), offset=500)


@register("banded_best_match_join")
def banded_best_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mt.best_remote(live_turns(spark, sf_dir).filter("role = 'Me'"), batch_turns(spark, sf_dir).filter("role = 'Colleagues'"), TERMS)
    return out.select("session", "id", "remote_id", "time_overlap", "similarity", "term_overlap", "distance_sec")


def _followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the text of the next one."""
    rows = live_turns(spark, sf_dir).withColumn("after", F.lead("text").over(Window.partitionBy("session").orderBy("id"))).filter("after is not null")
    return dealt(rows, "session", "id")


@register("text_similarity")
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _followed(spark, sf_dir)
    return rows.select("session", "id", st.text_similarity(F.col("text"), F.col("after")).alias("similarity"))


@register("sequence_ratio")
def sequence_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _followed(spark, sf_dir)
    return rows.select("session", "id", st.sequence_ratio(st.normalize_audit(F.col("text")), st.normalize_audit(F.col("after"))).alias("ratio"))


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = batch_turns(spark, sf_dir).select("session", (F.col("id") - 1000).alias("id"), F.col("tokens").alias("said"))
    return live_turns(spark, sf_dir).join(batch, ["session", "id"])


@register("wer")
def wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word errors of the batch text against the live one, by kind, and their rate."""
    e = _both(spark, sf_dir).select("session", "id", F.size("tokens").alias("words"), st.word_edits("tokens", "said").alias("e")).select("session", "id", "words", "e.*")
    errors = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    return e.withColumn("wer", F.when(F.col("words") > 0, errors / F.col("words")))


@register("lcs_length", f"{W}, p AS (SELECT a.session, a.id, a.tokens, b.tokens AS said FROM live a JOIN batch b ON b.session = a.session AND b.id = a.id + 1000) SELECT session, id, CAST(len(said) AS INTEGER) AS lcs FROM p")
def lcs_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch text is the live one without its last word here, so its length is what they have in common."""
    return _both(spark, sf_dir).select("session", "id", st.lcs_length("tokens", "said").alias("lcs"))


@register("clock_fit", """WITH p AS (SELECT user_id % 20 AS k, value AS x, value * 1.01 + 3 + (event_id % 13 - 6) + CASE WHEN event_id % 17 = 0 THEN 500 ELSE 0 END AS y FROM events), m AS (SELECT k, median(y - x) AS m FROM p GROUP BY k), n AS (SELECT p.* FROM p JOIN m USING (k) WHERE abs(y - x - m) <= 30), f AS (SELECT k, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM n GROUP BY k),
z AS (SELECT n.* FROM n JOIN f USING (k) WHERE abs(y - a * x - b) <= 10) SELECT k, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, count(*) AS used FROM z GROUP BY k""")
def clock_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    y = F.expr("value * 1.01e0 + 3 + (event_id % 13 - 6) + case when event_id % 17 = 0 then 500 else 0 end")
    out = mt.clock_fit(e.select((F.col("user_id") % 20).alias("k"), F.col("value").alias("x"), y.alias("y")), "k")
    return out.select("k", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "used")


def _track_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_turns(spark, sf_dir)


@register("bounded_merge")
def bounded_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.bounded_merge(_track_rows(spark, sf_dir), ["session", "role"])


@register("utterance_merge")
def utterance_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _track_rows(spark, sf_dir).withColumn("confidence", F.when(F.col("id") % 4 != 0, (F.col("id") % 10) / 10.0))
    return folds.utterance_merge(rows, ["session", "role"])


@register("interval_dedupe")
def interval_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = live_turns(spark, sf_dir).unionByName(batch_turns(spark, sf_dir).drop("suspicious"))
    return folds.interval_dedupe(both.drop("text"), ["session", "chunk", "role"])


@register("adjacent_dedupe_fold")
def adjacent_dedupe_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = live_turns(spark, sf_dir).unionByName(batch_turns(spark, sf_dir).drop("suspicious")).withColumnRenamed("role", "speaker")
    return folds.adjacent_dedupe(both.drop("content"), ["session"])


@register("causal_context")
def causal_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir).select(F.col("user_id").alias("chunk"), "id", (F.col("start") / 1e6).alias("start"), (F.col("end") / 1e6).alias("end"), F.when(F.col("id") % 3 == 0, "expensive_candidate").otherwise("unresolved").alias("route"))
    return folds.causal_context(rows, ["chunk"])


@register("lag_dedupe")
def lag_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live_turns(spark, sf_dir).unionByName(batch_turns(spark, sf_dir).drop("suspicious"))
    return folds.boundary_gate(rows.drop("text"), ["session", "role"])


@register("word_alignment_join")
def word_alignment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = live_turns(spark, sf_dir).select("session", "id", "start", "end", "tokens")
    raw = batch_turns(spark, sf_dir).select("session", (F.col("id") - 1000).alias("id"), "start", F.posexplode("tokens").alias("k", "word"))
    return folds.word_alignment(u, raw.select("session", "id", (F.col("start") + 300 * F.col("k")).cast("double").alias("at"), "word"), ["session", "id"])


@register("spread_sample")
def spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live_turns(spark, sf_dir).select("session", "id", F.col("start").cast("double").alias("at"), F.sha2(F.concat(F.lit("salt:"), F.col("id").cast("string")), 256).alias("salt"), (F.col("content") > 4).alias("domain"))
    return folds.spread_sample(rows, ["session"], 4)


@register("word_chronology")
def word_chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What word times say of each turn of Me and the next turn of the other side: texts of the live turns, words and times of the batch ones.

    Shares of words that only one side has stand for the evidence of sound. Matching blocks have no SQL; a test holds the
    rule against a plain reading of it.
    """
    live = live_turns(spark, sf_dir)
    after = Window.partitionBy("session").orderBy("id")
    items = live.withColumn("remote_id", F.lead("id").over(after)).withColumn("remote_tokens", F.lead("tokens").over(after)).withColumn("other", F.lead("role").over(after)).filter("role = 'Me' and other = 'Colleagues'")
    own, far = F.size(F.array_except("tokens", "remote_tokens")), F.size(F.array_except("remote_tokens", "tokens"))
    items = items.select("session", "id", "remote_id", F.col("tokens").alias("me_tokens"), "remote_tokens", (100 * own / F.greatest(F.size("tokens"), F.lit(1))).alias("local_evidence"), (own / F.greatest(own + far, F.lit(1))).alias("local_only"), (F.size(F.array_intersect("tokens", "remote_tokens")) / F.greatest(own + far, F.lit(1))).alias("double_talk"), (far / F.greatest(own + far, F.lit(1))).alias("remote_only"), F.when(F.size("tokens") < 3, "remote_leak_or_asr_segmentation").alias("upstream"))
    word = F.transform("tokens", lambda t, k: F.struct(t.alias("token"), (F.col("start") / 1000 + 0.3 * k).alias("start"), (F.col("start") / 1000 + 0.3 * k + 0.25).alias("end"), F.least(F.lit(0.95), F.lit(0.1) + 0.15 * F.length(t)).alias("probability")))
    heard = batch_turns(spark, sf_dir).select("session", (F.col("id") - 1000).alias("of"), word.alias("words"), F.when(F.col("suspicious"), "decode_error").otherwise("ok").alias("status"))
    sides = items.select("session", "id", F.explode(F.array(F.struct(F.lit("mic_clean").alias("source"), F.col("id").alias("of")), F.struct(F.lit("remote").alias("source"), F.col("remote_id").alias("of")))).alias("x")).select("session", "id", "x.*")
    out = chronology.classify(items, sides.join(heard, ["session", "of"]).drop("of"), ["session", "id"])
    return out.select("session", "id", "remote_id", "label", "localized", "confidence", "reason", "independent_local", "actual_overlap", "signed_gap", F.col("mic_me.a.score").alias("me_score"), F.col("remote_remote.a.score").alias("remote_score"), F.transform("mic_me.w", lambda w: w["start"]).alias("me_word_starts"))
