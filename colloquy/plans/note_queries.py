"""Queries of note scoring, terms and remaining text functions, each with independent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions import strings as st
from colloquy.functions import text as tx
from colloquy.operators import decisions as dc
from colloquy.operators import notes as nt
from colloquy.operators.joins import dealt
from colloquy.plans.registry import register
from colloquy.plans.text_queries import NORM
from colloquy.plans.views import LIVE_SQL, TURNS_SQL, evidence, evidence_sql, flag, live_turns, pick, share, table, turns

#: A lexicon for the driver's invented prose: its commonest words stand for markers.
LEX = nt.Lexicon(
    terms=["que", "der", "ion"], stop=["the", "and", "that", "with", "for"], strong=["for the"], medium=["was", "must"], soft=["with"], verbs=["is", "was"], weak_verbs=["are"], owners=["he", "it"], times=["this", "today"],
    facilitation=["by the"], abstract=["of the"], explicit=["in the"], dialogue=["agreed", "the"], choices=["be"], risks=["risk", "that"], worries=["problem", "with"], consequences=["if", "then"], hedges=["may", "can"], solved=["from"], unresolved=["von"], asking=["what", "how", "can"], who=["who", "when"], topics=["und"], answers=["yes", "because", "ist"], filler=["ok", "yes"],
)
W = f"WITH {LIVE_SQL}, y AS (SELECT session, id, s, e, role, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low, list_filter(string_split({NORM}, ' '), lambda x: x <> '') AS t, id % 5 = 0 AS needs_review, id % 7 = 0 AS unresolved FROM live), z AS (SELECT *, len(list_distinct(list_filter(t, lambda x: length(x) >= 3 AND x NOT IN ('the', 'and', 'that', 'with', 'for')))) AS n, len(list_filter(['que', 'der', 'ion'], lambda x: list_contains(t, x))) AS k FROM y)"


def _has(*phrases: str) -> str:
    return "(" + " OR ".join(f"contains(low, '{p}')" for p in phrases) + ")"


def _any(*words: str) -> str:
    return "list_has_any(t, [" + ", ".join(f"'{w}'" for w in words) + "])"


def _sum(*terms: tuple[str, int]) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in terms)


def _clamp(x: str) -> str:
    return f"1e0 * greatest(0, least(100, {x}))"


def _status(x: str, a: int, b: int, c: int) -> str:
    return f"CASE WHEN {x} >= {a} THEN 'selected' WHEN {x} >= {b} THEN 'candidate' WHEN {x} >= {c} THEN 'weak' ELSE 'hidden' END"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_turns(spark, sf_dir).withColumn("needs_review", F.col("id") % 5 == 0).withColumn("unresolved", F.col("id") % 7 == 0)


_OPEN = "CASE WHEN unresolved THEN -10 ELSE 0 END"
_THING = "len(list_filter(range(1, len(t) + 1), lambda i: t[i] IN ('is', 'was', 'are') AND len(list_filter(t[i + 1:i + 4], lambda u: length(u) >= 3 AND u NOT IN ('the', 'and', 'that', 'with', 'for', 'is', 'was', 'are'))) > 0)) > 0"


@register("action_scoring", f"""{W}, a AS (SELECT *, {_has("for the")} AS st, {_has("was", "must")} AS md, {_has("with")} AS so, {_any("is", "was")} AS vb, {_any("are")} AS wv, {_THING} AS ob, {_has("of the")} AS ab, {_has("by the")} AS ch FROM z),
b AS (SELECT *, CASE WHEN ch THEN 25e0 ELSE {_clamp(_sum(("st", 25), ("md", 18), ("so", 10), ("vb", 22), ("wv AND ob", 10), ("wv AND NOT ob", -12), ("ob", 22), ("NOT ob", -20), ("NOT ob AND NOT st", -25), ("st OR " + _any("he", "it"), 15), (_any("this", "today"), 6), ("needs_review", -15), ("NOT needs_review", 8), ("ab", -25), ("md AND NOT st AND NOT vb AND NOT ob", -18), ("n < 3", -10), ("n > 45", -10), ("contains(text, '?')", -15)) + " + least(10, k * 5) + " + _OPEN)} END AS score FROM a WHERE st OR md OR so OR ch OR vb OR wv)
SELECT session, id, score, CASE WHEN ch OR ab OR (NOT ob AND NOT st) THEN 'hidden' ELSE {_status("score", 75, 55, 35)} END AS status FROM b""")
def action_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nt.score_actions(_turns(spark, sf_dir), LEX).filter("score is not null").select("session", "id", "score", "status")


@register("decision_scoring", f"""{W}, a AS (SELECT *, {_has("in the")} AS ex, {_has("agreed", "the")} AS di, {_has("by the")} AS ch FROM z), b AS (SELECT *, di AND NOT ex AND n < 3 AS thin FROM a WHERE (ex OR di) AND trim(low) NOT IN ('ok', 'yes')),
c AS (SELECT *, CASE WHEN ch AND NOT ex THEN 25e0 ELSE {_clamp(_sum(("ex", 50), ("di", 20), ("k > 0", 15), ("n >= 3", 10), (_any("be"), 15), ("thin", -35), ("needs_review", -15), ("NOT needs_review", 8), ("contains(text, '?')", -20), ("n < 2", -20)) + " + " + _OPEN)} END AS score FROM b)
SELECT session, id, score, CASE WHEN thin OR (ch AND NOT ex) THEN 'hidden' ELSE {_status("score", 75, 55, 35)} END AS status FROM c""")
def decision_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nt.score_decisions(_turns(spark, sf_dir), LEX).filter("score is not null").select("session", "id", "score", "status")


@register("risk_scoring", f"""{W}, a AS (SELECT *, {_has("risk", "that")} AS st, {_has("problem", "with")} AS md, {_has("if", "then")} AS co FROM z),
b AS (SELECT *, {_clamp(_sum(("st", 35), ("md", 20), ("co", 20), ("k > 0", 10), (_any("may", "can"), 8), (_has("from"), -30), ("contains(low, 'problem') AND NOT co", -15), ("needs_review", -10), ("NOT needs_review", 8)) + " + " + _OPEN)} AS score FROM a WHERE st OR md) SELECT session, id, score, {_status("score", 70, 50, 35)} AS status FROM b""")
def risk_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nt.score_risks(_turns(spark, sf_dir), LEX).filter("score is not null").select("session", "id", "score", "status")


@register("question_scoring", f"""{W}, a AS (SELECT x.*, {" OR ".join(f"starts_with(low, '{q} ') OR contains(low, ' {q} ')" for q in LEX.asking)} AS asks, EXISTS (SELECT 1 FROM (SELECT session, s, low AS l2, row_number() OVER (PARTITION BY session ORDER BY id) AS r FROM z) q JOIN (SELECT session AS s2, id AS i2, row_number() OVER (PARTITION BY session ORDER BY id) AS r2 FROM z) p ON p.s2 = q.session AND q.r BETWEEN p.r2 + 1 AND p.r2 + 5
 WHERE q.session = x.session AND p.i2 = x.id AND q.s - x.e <= 90000 AND (contains(l2, 'yes') OR contains(l2, 'because') OR contains(l2, 'ist'))) AS answered FROM z x),
b AS (SELECT *, {_clamp(_sum(("contains(text, '?') OR asks", 35), (_has("von"), 25), ("k > 0", 10), (_any("who", "when"), 15), (_has("und"), -25), ("answered", -30), ("needs_review", -10), ("NOT needs_review", 8)) + " + " + _OPEN)} AS score FROM a WHERE contains(text, '?') OR asks OR contains(low, 'von')) SELECT session, id, score, {_status("score", 70, 50, 35)} AS status FROM b""")
def question_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nt.score_questions(_turns(spark, sf_dir), LEX, "session", "id").filter("score is not null").select("session", "id", "score", "status")


@register("salience", f"""{W} SELECT session, id, CAST(greatest(0, least(n, 20) * 2 + k * 5 + {_sum(("needs_review", -12), ("NOT needs_review", 8), (_has("was", "must", "in the", "risk", "that", "von"), 8), ("trim(low) IN ('ok', 'yes')", -35), (_has("by the"), -30), ("n < 3", -15), ("n > 45", -8))} + {_OPEN}) AS INTEGER) AS salience FROM z""")
def salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nt.salience(_turns(spark, sf_dir), LEX).select("session", "id", "salience")


@register("topic_keywords", f"""{W}, u AS (SELECT session, unnest(list_filter(['que', 'der', 'ion'], lambda x: list_contains(t, x))) AS term, 8 AS w FROM z UNION ALL SELECT session, unnest(list_distinct(list_filter(t, lambda x: length(x) >= 4 AND x NOT IN ('the', 'and', 'that', 'with', 'for', 'ok', 'yes')))), 2 FROM z),
s AS (SELECT session, term, CAST(sum(w) AS BIGINT) AS weight FROM u GROUP BY ALL HAVING sum(w) >= 3) SELECT session, term, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY weight DESC, term) AS rank FROM s) WHERE rank <= 4""")
def topic_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nt.topic_keywords(_turns(spark, sf_dir), ["session"], LEX)


@register("domain_term_overlap", f"""WITH b AS (SELECT item_id, list_filter(string_split({NORM}, ' '), lambda x: x <> '') AS t FROM benchmark), d AS (SELECT item_id, list_filter(['the', 'der', 'les', 'los', 'of', 'et'], lambda x: list_contains(t, x)) AS d FROM b)
SELECT a.item_id, CASE WHEN len(a.d) = 0 OR len(b.d) = 0 THEN 0.0 ELSE CAST(len(list_intersect(a.d, b.d)) AS DOUBLE) / len(list_distinct(list_concat(a.d, b.d))) END AS overlap FROM d a JOIN d b ON b.item_id = a.item_id + 1""")
def domain_term_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "benchmark")
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return a.join(b, "item_id").select("item_id", st.term_overlap(F.col("text"), F.col("other"), ["the", "der", "les", "los", "of", "et"]).alias("overlap"))


@register("domain_term_accuracy", f"""WITH b AS (SELECT item_id, list_filter(string_split({NORM}, ' '), lambda x: x <> '') AS t FROM benchmark), d AS (SELECT item_id, list_filter(['the', 'der', 'les', 'los', 'of', 'et'], lambda x: list_contains(t, x)) AS d FROM b)
SELECT a.item_id, len(a.d) AS present, len(list_intersect(a.d, b.d)) AS correct FROM d a JOIN d b ON b.item_id = a.item_id + 1""")
def domain_term_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the reference text, and those of them that the other text has as well."""
    terms = ["the", "der", "les", "los", "of", "et"]
    a = table(spark, sf_dir, "benchmark")
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    own, far = st.terms_in(F.col("text"), terms), st.terms_in(F.col("other"), terms)
    return a.join(b, "item_id").select("item_id", F.size(own).cast("long").alias("present"), F.size(F.array_intersect(own, far)).cast("long").alias("correct"))


@register("domain_pack_scan", f"SELECT doc_id, list_filter(['lake', 'the road', 'haus'], lambda x: contains(' ' || {NORM} || ' ', ' ' || x || ' ')) AS terms FROM documents")
def domain_pack_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a pack, phrases included, that a text holds as whole words."""
    padded = F.concat(F.lit(" "), tx.normalize(F.col("text")), F.lit(" "))
    terms = F.array(*map(F.lit, ["lake", "the road", "haus"]))
    return table(spark, sf_dir, "documents").select("doc_id", F.filter(terms, lambda t: padded.contains(F.concat(F.lit(" "), t, F.lit(" ")))).alias("terms"))


@register("normalize_audit", "SELECT doc_id, md5(trim(regexp_replace(replace(lower(text), 'ё', 'е'), '[^0-9a-zа-я_+-]+', ' ', 'g'))) AS digest FROM documents")
def normalize_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(st.normalize_audit(F.col("text"))).alias("digest"))


@register("normalize_nfkc")
def normalize_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(st.normalize_nfkc("text")).alias("digest"))


@register("display_token_spans")
def display_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = turns(spark, sf_dir).select("session", "turn", F.posexplode(st.display_token_spans("text")).alias("place", "x"))
    return spans.select("session", "turn", "place", "x.token", "x.start", "x.end")


_N = f"{LIVE_SQL}, n AS (SELECT session, id, tokens AS a, lead(tokens) OVER (PARTITION BY session ORDER BY id) AS b FROM live)"


def _next(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live_turns(spark, sf_dir).select("session", "id", F.col("tokens").alias("a"), F.lead("tokens").over(Window.partitionBy("session").orderBy("id")).alias("b"))
    return rows.filter("b is not null")


@register("suffix_prefix_overlap_fuzzy", f"""WITH {_N}, m AS (SELECT session, id, a, list_concat(list_concat(a[len(a) - 4 + 1:len(a) - 1], [coalesce(a[len(a)], '') || 'xyz']), b) AS b FROM n WHERE b IS NOT NULL)
SELECT session, id, coalesce(list_max(list_filter(range(3, least(32, len(a), len(b)) + 1), lambda k: a[len(a) - k + 1:len(a) - 1] = b[1:k - 1] AND (a[len(a)] = b[k] OR (length(a[len(a)]) >= 2 AND length(b[k]) >= 4 AND starts_with(b[k], a[len(a)]))))), 0) AS k FROM m""")
def suffix_prefix_overlap_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next turns that take up the last four words, the last of them longer now."""
    tail = F.slice("a", F.greatest(F.size("a") - 3, F.lit(1)), F.greatest(F.least(F.size("a") - 1, F.lit(3)), F.lit(0)))
    last = F.array(F.concat(F.coalesce(F.get("a", F.size("a") - 1), F.lit("")), F.lit("xyz")))
    rows = _next(spark, sf_dir).withColumn("b", F.concat(tail, last, F.col("b")))
    return rows.select("session", "id", st.suffix_prefix_fuzzy(F.col("a"), F.col("b")).cast("long").alias("k"))


@register("fuzzy_suffix_contains", f"""WITH {_N}, m AS (SELECT session, id, a, list_concat([substr(coalesce(a[len(a) - 3], ''), 2)], a[len(a) - 2:]) AS c FROM n WHERE len(a) >= 4)
SELECT session, id, len(a[len(a) - 3]) >= 5 AND length(c[1]) >= 4 AND (suffix(a[len(a) - 3], c[1]) OR suffix(c[1], right(a[len(a) - 3], 4))) AS contained FROM m""")
def fuzzy_suffix_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live_turns(spark, sf_dir).select("session", "id", F.col("tokens").alias("a")).filter(F.size("a") >= 4)
    short = F.concat(F.array(F.expr("substr(a[size(a) - 4], 2)")), F.slice("a", -3, 3))
    return rows.select("session", "id", st.fuzzy_suffix_contains(F.col("a"), short).alias("contained"))


@register("adjacent_repeat", f"""WITH {LIVE_SQL}, m AS (SELECT session, id, CASE WHEN id % 3 = 0 THEN list_concat(tokens[1:5], tokens) ELSE tokens END AS a FROM live), c AS (SELECT session, id, unnest(range(3, 17)) AS k, a FROM m), p AS (SELECT session, id, k, unnest(range(0, len(a) - 2 * k + 1)) AS i, a FROM c),
r AS (SELECT session, id, k, i, row_number() OVER (PARTITION BY session, id ORDER BY k DESC, i) AS r FROM p WHERE a[i + 1:i + k] = a[i + k + 1:i + 2 * k]) SELECT session, id, CAST(i AS BIGINT) AS start, CAST(k AS BIGINT) AS length FROM r WHERE r = 1""")
def adjacent_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("id") % 3 == 0, F.concat(F.slice("tokens", 1, 5), F.col("tokens"))).otherwise(F.col("tokens"))
    rows = dealt(live_turns(spark, sf_dir).select("session", "id", a.alias("a")), "session", "id").withColumn("x", st.adjacent_repeat(F.col("a"))).filter("x is not null")
    return rows.select("session", "id", F.col("x.start").cast("long").alias("start"), F.col("x.length").cast("long").alias("length"))


@register("strip_hallucination", r"""WITH t AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN text || ' [Music] more' WHEN 1 THEN 'Thank you. ' || text WHEN 2 THEN '... thank you for watching, !' ELSE 'Subtitles by John. ' || text END AS x FROM benchmark),
a AS (SELECT item_id, CASE WHEN contains(lower(x), '[music]') THEN substr(x, 1, instr(lower(x), '[music]') - 1) ELSE x END AS x FROM t), b AS (SELECT item_id, regexp_replace(regexp_replace(regexp_replace(x, 'subtitles by \w+', ' ', 'gi'), 'thank you for watching', ' ', 'gi'), 'thank you', ' ', 'gi') AS x FROM a)
SELECT item_id, regexp_replace(regexp_replace(regexp_replace(x, '[ \t\n\r\f\x0B]+', ' ', 'g'), '^[.!?, ]+', ''), '[.!?, ]+$', '') AS clean FROM b""")
def strip_hallucination(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("item_id") % 4, F.col("text")
    x = F.when(k == 0, F.concat(text, F.lit(" [Music] more"))).when(k == 1, F.concat(F.lit("Thank you. "), text)).when(k == 2, "... thank you for watching, !").otherwise(F.concat(F.lit("Subtitles by John. "), text))
    return table(spark, sf_dir, "benchmark").select("item_id", st.strip_fragments(x, ["[music]"], r"subtitles by \w+", ["thank you", "thank you for watching"]).alias("clean"))


@register("suspicious_fragment_flag", "SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'ж' WHEN 1 THEN 'я' WHEN 2 THEN 'да' WHEN 3 THEN 'Ц.' ELSE 'ы ы' END IN ('ж', 'Ц.') AS suspicious FROM events")
def suspicious_fragment_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One letter alone, but for those that are words."""
    k = F.col("user_id") % 5
    text = F.when(k == 0, "ж").when(k == 1, "я").when(k == 2, "да").when(k == 3, "Ц.").otherwise("ы ы")
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-zа-яё0-9]+)"), 1)
    one = F.get(words, F.lit(0))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce((F.size(words) == 1) & one.rlike("^[а-яё]$") & ~one.isin("а", "в", "и", "к", "о", "с", "у", "я"), F.lit(False)).alias("suspicious"))


@register("parse_datetime", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(1700000000 + event_id AS BIGINT) WHEN 1 THEN CAST(1700000000 + event_id - 7200 AS BIGINT) WHEN 2 THEN CAST(1700000000 + event_id AS BIGINT) END AS epoch FROM events""")
def parse_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zoned, offset and zoneless ISO times; what is no time is null."""
    at, k = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id")), F.col("event_id") % 4
    text = F.when(k == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+02:00'")).when(k == 2, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).otherwise("yesterday")
    return table(spark, sf_dir, "events").select("event_id", F.unix_seconds(st.parse_datetime(text)).alias("epoch"))


@register("session_end_coalesce", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id WHEN event_id % 3 = 0 THEN event_id + 10 WHEN event_id % 5 = 0 THEN event_id + 20 ELSE event_id + 30 END AS ended FROM events")
def session_end_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ended_at, else stopped_at, else created_at, else the file's time."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.when(i % 2 == 0, i), F.when(i % 3 == 0, i + 10), F.when(i % 5 == 0, i + 20), i + 30).alias("ended"))


@register("overlap_ratio", f"WITH {TURNS_SQL} SELECT session, turn, CAST(greatest(0, least(e, ns + 500) - greatest(s, ns - 500)) AS DOUBLE) / greatest(1, least(e - s, 1000)) AS ratio FROM (SELECT *, lead(s) OVER (PARTITION BY session ORDER BY turn) AS ns FROM turns) WHERE ns IS NOT NULL")
def overlap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap as a share of the shorter interval, which counts 1 at least."""
    rows = turns(spark, sf_dir).withColumn("ns", F.lead("start").over(Window.partitionBy("session").orderBy("turn"))).filter("ns is not null")
    s, e, a, b = F.col("start"), F.col("end"), F.col("ns") - 500, F.col("ns") + 500
    return rows.select("session", "turn", (F.greatest(F.least(e, b) - F.greatest(s, a), F.lit(0)) / F.greatest(F.lit(1), F.least(e - s, b - a))).alias("ratio"))


@register("safe_cast", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN TRY_CAST(event_type AS DOUBLE) WHEN 2 THEN CAST(user_id AS DOUBLE) ELSE value END AS number FROM events")
def safe_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and strings of them; booleans are no numbers."""
    k = F.col("event_id") % 4
    raw = F.when(k == 0, "1").when(k == 1, F.col("event_type")).when(k == 2, F.col("user_id").cast("string")).otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", st.safe_number(raw, k == 0).alias("number"))


@register("nested_get", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, 'none' AS deep FROM events")
def nested_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value at a path, or a default where a step is missing."""
    p = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_variant_get(p, "$.k", "bigint"), F.lit(-1)).alias("k"), F.coalesce(F.try_variant_get(p, "$.a.b.c", "string"), F.lit("none")).alias("deep"))


@register("canonical_json", """SELECT doc_id, '{"lang":' || CASE WHEN lang IS NULL THEN 'null' ELSE '"' || lang || '"' END || ',"n_chars":' || n_chars || ',"source":"' || source || '"}' AS json FROM documents""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", st.canonical_json(source=F.col("source"), lang=F.col("lang"), n_chars=F.col("n_chars")).alias("json"))


@register("stable_id", """SELECT doc_id, 'cand_' || substr(sha256('{"kind":"loop","utterances":[' || doc_id || ',' || doc_id + 1 || ']}'), 1, 16) AS id FROM documents""")
def stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", st.stable_id("cand", kind=F.lit("loop"), utterances=F.array("doc_id", F.col("doc_id") + 1)).alias("id"))


_LOW = {
    "source": pick(7, "audio", "audio", "transcript_order", "audio"), "label": pick(11, "lost_me", "remote_duplicate", "remote_leak", "uncertain", "needs_review"), "verdict": pick(13, "probable_transcript_error", "needs_stronger_audio_judge", "needs_transcript_order_review"), "duration_sec": "6 * " + share(17) + " * " + share(19), "tokens": "(event_id * 23) % 9973 % 6", "content_tokens": "(event_id * 29) % 9973 % 4", "confidence": "0.5 + 0.5 * " + share(31),
    "protected_marker": flag(37, 6), "similarity": share(41), "containment": share(43), "coverage": share(47), "backchannel": flag(53, 3), "fuzzy_duplicate": flag(59, 4), "partial": flag(61, 2), "remote_backchannel": flag(67, 3), "overlap_sec": "10 * " + share(71), "lead_sec": "2 * " + share(73), "remote_inside": flag(79, 5), "wraps": flag(83, 5),
}


@register("low_materiality_filter", f"""WITH {evidence_sql(_LOW)}, a AS (SELECT *, duration_sec > 0 AND duration_sec <= 0.5 AND coverage <= 0.05 AND partial AS tiny, CASE WHEN backchannel THEN 3 WHEN content_tokens <= 1 THEN 2 ELSE 1.25 END AS most FROM x)
SELECT id FROM a WHERE CASE WHEN label = 'lost_me' AND verdict = 'probable_transcript_error' THEN duration_sec > 0 AND duration_sec <= 1.5 AND tokens <= 3 AND content_tokens <= 2 AND confidence <= 0.75 AND NOT protected_marker
 WHEN source = 'transcript_order' THEN label = 'needs_review' AND verdict = 'needs_transcript_order_review' AND NOT protected_marker AND (content_tokens <= 2 OR (remote_backchannel AND overlap_sec > 0 AND overlap_sec <= 8 AND lead_sec <= 1)) AND similarity <= 0.3 AND containment <= 0.05 AND NOT remote_inside AND NOT wraps
 WHEN label NOT IN ('remote_duplicate', 'remote_leak', 'uncertain') OR verdict NOT IN ('probable_transcript_error', 'needs_stronger_audio_judge') OR duration_sec <= 0 THEN FALSE WHEN NOT tiny AND (protected_marker OR duration_sec > most) THEN FALSE
 ELSE (label <> 'remote_duplicate' AND content_tokens <= 1) OR coverage <= 0.4 OR tiny OR (backchannel AND duration_sec <= 4) OR (label <> 'remote_duplicate' AND fuzzy_duplicate) OR (label = 'remote_duplicate' AND confidence >= 0.95 AND coverage >= 0.8 AND (similarity >= 0.92 OR containment >= 0.75 OR fuzzy_duplicate))
 OR (label = 'remote_duplicate' AND confidence >= 0.95 AND duration_sec <= 1 AND content_tokens <= 2 AND partial AND similarity >= 0.92 AND containment >= 0.75) OR (label <> 'remote_duplicate' AND content_tokens <= 2 AND similarity <= 0.3 AND containment <= 0.25) END""")
def low_materiality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir, _LOW).filter(dc.low_materiality()).select("id")


@register("pending_filter", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'reviewed_v1' ELSE 'current' END AS profile FROM events WHERE event_type IN ('view', 'purchase') OR event_type = CASE WHEN user_id % 2 = 0 THEN 'reviewed_v1' ELSE 'current' END OR (user_id % 2 = 0 AND event_id % 3 = 0)")
def pending_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions for the profile at hand, or for any; a cumulative reviewed profile takes those of all."""
    e = table(spark, sf_dir, "events").withColumn("profile", F.when(F.col("user_id") % 2 == 0, "reviewed_v1").otherwise("current"))
    made_for = F.when(~F.col("event_type").isin("view", "purchase"), F.col("event_type"))
    return e.filter(dc.pending(made_for, F.col("profile"), F.col("event_id") % 3 == 0)).select("event_id", "profile")
