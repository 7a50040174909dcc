"""Queries of text functions and multiset comparisons, each with independent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators import evaluation as ev
from colloquy.operators import review as rv
from colloquy.plans.registry import register
from colloquy.plans.views import TURNS_SQL, WORDS_SQL, table, turns, words

W = f"WITH {TURNS_SQL}, {WORDS_SQL}"
NEXT = "n AS (SELECT *, lead(tokens) OVER (PARTITION BY session ORDER BY turn) AS after FROM words)"
NORM = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}+/-]+', ' ', 'g'), ' +', ' ', 'g'))"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).withColumn("after", F.lead("tokens").over(Window.partitionBy("session").orderBy("turn"))).filter("after is not null")


@register("normalize_for_compare", f"SELECT doc_id, md5({NORM}) AS digest FROM documents")
def normalize_for_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.normalize(F.col("text"))).alias("digest"))


@register("tokenize", f"SELECT doc_id, len(list_filter(string_split({NORM}, ' '), lambda x: x <> '')) AS n_tokens FROM documents")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.tokens(F.col("text"))).cast("long").alias("n_tokens"))


_STOP = ["the", "and", "that", "with", "for"]


@register("content_tokens", f"SELECT doc_id, len(list_distinct(list_filter(string_split({NORM}, ' '), lambda x: length(x) >= 3 AND x NOT IN ('the', 'and', 'that', 'with', 'for')))) AS n FROM documents")
def content_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.content_tokens(F.col("text"), _STOP)).cast("long").alias("n"))


@register("contentful_filter", f"SELECT conv_id, turn FROM conversations WHERE len(list_filter(string_split({NORM}, ' '), lambda x: length(x) >= 3 AND x NOT IN ('the', 'and', 'that', 'with', 'for'))) >= 2")
def contentful_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    use = F.filter(tx.tokens(F.col("text")), lambda t: (F.length(t) >= 3) & ~t.isin(_STOP))
    return table(spark, sf_dir, "conversations").filter(F.size(use) >= 2).select("conv_id", "turn")


@register("clean_text", r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS digest FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.clean(F.col("text"))).alias("digest"))


@register("short_text", "SELECT conv_id, turn, CASE WHEN length(text) > 40 THEN rtrim(substr(text, 1, 39)) || '…' ELSE text END AS short FROM conversations")
def short_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.short(F.col("text"), 40).alias("short"))


@register("sha256", "SELECT doc_id, sha256(text) AS sha FROM documents")
def sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@register("salted_rank", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('salt:' || doc_id), doc_id) AS rank FROM documents")
def salted_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks by salted hash: its first digits are the buckets that are ranked apart."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.concat(F.lit("salt:"), F.col("doc_id").cast("string")), 256).alias("h"))
    return rv.ranked(rows, ["source"], ["h", "doc_id"], F.conv(F.substring("h", 1, 3), 16, 10).cast("long")).select("doc_id", "rank")


@register("char_ngrams", f"""SELECT item_id, CASE WHEN length(b) = 0 THEN 0 WHEN length(b) <= 3 THEN 1 ELSE len(list_distinct(list_transform(range(1, length(b) - 1), lambda i: substr(b, i, 3)))) END AS n FROM (SELECT item_id, replace({NORM}, ' ', '') AS b FROM (SELECT item_id, CASE WHEN item_id % 9 = 0 THEN ' ' ELSE text END AS text FROM benchmark))""")
def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("item_id") % 9 == 0, " ").otherwise(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(tx.char_ngrams(text)).cast("long").alias("n"))


@register("jaccard", f"""{W}, {NEXT} SELECT session, turn, CASE WHEN len(tokens) = 0 OR len(after) = 0 THEN 0.0 ELSE CAST(len(list_intersect(list_distinct(tokens), after)) AS DOUBLE) / len(list_distinct(list_concat(tokens, after))) END AS jaccard FROM n WHERE after IS NOT NULL""")
def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("session", "turn", tx.jaccard(F.col("tokens"), F.col("after")).alias("jaccard"))


@register("token_set_intersection", f"""{W}, {NEXT} SELECT session, turn, CASE WHEN len(tokens) = 0 THEN 0.0 ELSE CAST(len(list_intersect(list_distinct(tokens), after)) AS DOUBLE) / len(list_distinct(tokens)) END AS containment FROM n WHERE after IS NOT NULL""")
def token_set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("session", "turn", tx.containment(F.col("tokens"), F.col("after")).alias("containment"))


@register("suffix_prefix_overlap", f"""{W}, {NEXT} SELECT session, turn, list_max(list_filter(range(0, least(len(tokens), len(after)) + 1), lambda k: k = 0 OR tokens[len(tokens) - k + 1:] = after[:k])) AS k FROM n WHERE after IS NOT NULL""")
def suffix_prefix_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("session", "turn", tx.suffix_prefix(F.col("tokens"), F.col("after")).cast("long").alias("k"))


@register("contains_tokens", f"""{W}, {NEXT} SELECT session, turn, coalesce(list_filter(range(0, len(after)), lambda i: i + 2 <= len(after) AND after[i + 1:i + 2] = tokens[1:2])[1], -1) AS at FROM n WHERE after IS NOT NULL AND len(tokens) >= 2""")
def contains_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = _pairs(spark, sf_dir).filter(F.size("tokens") >= 2)
    return two.select("session", "turn", tx.find_sublist(F.col("after"), F.slice("tokens", 1, 2)).cast("long").alias("at"))


@register("phrase_occurrences", f"""{W}, {NEXT} SELECT session, turn, len(list_filter(range(0, len(after)), lambda i: after[i + 1] = tokens[1])) AS n FROM n WHERE after IS NOT NULL AND len(tokens) >= 1""")
def phrase_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _pairs(spark, sf_dir).filter(F.size("tokens") >= 1)
    return one.select("session", "turn", tx.count_sublist(F.col("after"), F.slice("tokens", 1, 1)).cast("long").alias("n"))


@register("repeated_unit", """SELECT doc_id, list_min(list_filter([1, 2, 3, 4], lambda k: len(t) % k = 0 AND len(t) / k >= 4 AND array_to_string(t[:len(t) - k], ' ') = array_to_string(t[k + 1:], ' '))) AS unit
FROM (SELECT doc_id, list_filter(string_split(""" + NORM + """, ' '), lambda x: x <> '') AS t FROM documents)""")
def repeated_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", tx.repeated_unit(F.col("t")).alias("unit"))


@register("edit_le_1", f"""{W}, {NEXT}, x AS (SELECT session, turn, unnest(tokens) AS a, after FROM n WHERE after IS NOT NULL) SELECT session, turn, count(*) AS tokens, count_if(len(list_filter(after, lambda b: levenshtein(a, b) <= 1)) > 0) AS near FROM x GROUP BY ALL""")
def edit_le_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens of a turn are at most one edit away from one of the next turn."""
    both = _pairs(spark, sf_dir).filter(F.size("tokens") > 0)
    near = F.filter("tokens", lambda a: F.exists("after", lambda b: tx.edit_le_1(a, b)))
    return both.select("session", "turn", F.size("tokens").cast("long").alias("tokens"), F.size(near).cast("long").alias("near"))


@register("cer", """WITH b AS (SELECT item_id, regexp_replace(text, '[^a-z ]', '', 'g') AS text FROM benchmark) SELECT a.item_id, CAST(levenshtein(a.text, b.text) AS DOUBLE) / length(a.text) AS cer FROM b a JOIN b ON b.item_id = a.item_id + 1""")
def cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "benchmark").withColumn("text", F.regexp_replace("text", "[^a-z ]", ""))
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return a.join(b, "item_id").select("item_id", (F.levenshtein("text", "other") / F.length("text")).alias("cer"))


@register("phrase_matches", """SELECT conv_id, turn, list_filter(['the', 'der', 'une', 'los'], lambda m: contains(lower(text), m)) AS found FROM conversations""")
def phrase_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = F.array(*map(F.lit, ["the", "der", "une", "los"]))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.filter(markers, lambda m: F.contains(F.lower("text"), m)).alias("found"))


@register("format_clock", "SELECT event_id, CASE WHEN value >= 3600 THEN printf('%02d:%02d:%02d', CAST(floor(value) AS BIGINT) // 3600, CAST(floor(value) AS BIGINT) // 60 % 60, CAST(floor(value) AS BIGINT) % 60) ELSE printf('%02d:%02d', CAST(floor(value) AS BIGINT) // 60, CAST(floor(value) AS BIGINT) % 60) END AS clock FROM events")
def format_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tx.format_clock(F.col("value")).alias("clock"))


@register("parse_clock", "SELECT event_id, CAST(floor(value) AS BIGINT) AS seconds FROM events")
def parse_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_clock(spark, sf_dir).select("event_id", tx.parse_clock(F.col("clock")).cast("long").alias("seconds"))


_BAG = f"""{W}, x AS (SELECT session, turn, unnest(tokens) AS t FROM words), c AS (SELECT session, turn, t, count(*) AS n FROM x GROUP BY ALL),
s AS (SELECT session, turn, lead(turn) OVER (PARTITION BY session ORDER BY turn) AS nxt, len(tokens) AS size, lead(len(tokens)) OVER (PARTITION BY session ORDER BY turn) AS nsize FROM words),
m AS (SELECT a.session, a.turn, sum(least(a.n, b.n)) AS inter FROM c a JOIN s USING (session, turn) JOIN c b ON b.session = a.session AND b.turn = s.nxt AND b.t = a.t GROUP BY ALL)"""


@register("multiset_recall", _BAG + " SELECT session, turn, CAST(coalesce(inter, 0) AS DOUBLE) / nullif(size, 0) AS recall FROM s LEFT JOIN m USING (session, turn) WHERE nxt IS NOT NULL")
def multiset_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.multiset_prf(_pairs(spark, sf_dir), ["session", "turn"], "tokens", "after").select("session", "turn", "recall")


@register("multiset_prf", _BAG + """, r AS (SELECT session, turn, CAST(coalesce(inter, 0) AS DOUBLE) / nullif(size, 0) AS recall, CAST(coalesce(inter, 0) AS DOUBLE) / nullif(nsize, 0) AS precision FROM s LEFT JOIN m USING (session, turn) WHERE nxt IS NOT NULL)
SELECT session, turn, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) WHEN precision + recall = 0 THEN 0.0 END AS f1 FROM r""")
def multiset_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.multiset_prf(_pairs(spark, sf_dir), ["session", "turn"], "tokens", "after").select("session", "turn", "precision", "recall", "f1")


@register("multiset_except", f"{W}, {NEXT}, a AS (SELECT session, turn, unnest(tokens) AS t FROM n WHERE after IS NOT NULL), b AS (SELECT session, turn, unnest(after) AS t FROM n WHERE after IS NOT NULL) SELECT session, turn, t AS token FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)")
def multiset_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    return p.select("session", "turn", F.explode(tx.multiset_except(F.col("tokens"), F.col("after"))).alias("token"))


@register("multiset_intersect", f"{W}, {NEXT}, a AS (SELECT session, turn, unnest(tokens) AS t FROM n WHERE after IS NOT NULL), b AS (SELECT session, turn, unnest(after) AS t FROM n WHERE after IS NOT NULL) SELECT session, turn, t AS token FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b)")
def multiset_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    return p.select("session", "turn", F.explode(tx.multiset_intersect(F.col("tokens"), F.col("after"))).alias("token"))


_SHORT = """h AS (SELECT event_id AS id, CASE user_id % 4 WHEN 0 THEN 'thank you' WHEN 1 THEN 'so' WHEN 2 THEN 'see you all tomorrow' ELSE NULL END AS text, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + CAST(floor(value * 100) AS BIGINT) AS e, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id * 37 % 101) / 101e0 END AS p, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id * 53 % 103) / 103e0 END AS low FROM events)"""


@register("hallucination_filter", f"""WITH {_SHORT} SELECT id FROM h WHERE len(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')) <= 2 AND e - s >= 3000 AND (coalesce(p < 0.64, FALSE) OR coalesce(low >= 0.45, FALSE))""")
def hallucination_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long remote stretches of at most two words that the recogniser wasn't sure of."""
    text = F.when(F.col("user_id") % 4 == 0, "thank you").when(F.col("user_id") % 4 == 1, "so").when(F.col("user_id") % 4 == 2, "see you all tomorrow")
    h = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), text.alias("text"), F.floor(F.col("value") * 100).alias("ms"), F.when(F.col("event_id") % 5 != 0, F.expr("(event_id * 37 % 101) / 101e0")).alias("p"), F.when(F.col("event_id") % 7 != 0, F.expr("(event_id * 53 % 103) / 103e0")).alias("low"))
    return h.filter(tx.probable_noise(F.col("text"), F.col("ms"), F.col("p"), F.col("low"))).select("id")
