"""Queries of evaluation, review, gates and vectors, each with independent SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators import evaluation as ev
from colloquy.operators import review as rv
from colloquy.plans.registry import register
from colloquy.plans.views import INTERVALS_SQL, intervals, table

W = f"WITH {INTERVALS_SQL}"
PRED = "p AS (SELECT d.doc_id, l.quality AS t, CASE WHEN d.n_chars % 7 < 2 THEN 0 ELSE 1 END AS p, (d.n_chars % 100) / 100.0 AS conf, d.lang, d.source, d.n_chars FROM documents d JOIN labels l USING (doc_id))"
P = f"WITH {PRED}"


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", F.col("quality").alias("t"), F.when(F.col("n_chars") % 7 < 2, 0).otherwise(1).alias("p"), ((F.col("n_chars") % 100) / 100.0).alias("conf"), "lang", "source", "n_chars")


@register("bcubed", """WITH c AS (SELECT lang AS t, source AS p, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY t) AS tn, sum(n) OVER (PARTITION BY p) AS pn FROM c), z AS (SELECT sum(CAST(n * n AS DOUBLE) / pn) / sum(n) AS a, sum(CAST(n * n AS DOUBLE) / tn) / sum(n) AS b FROM s)
SELECT a AS precision, b AS recall, 2 * a * b / (a + b) AS f1 FROM z""")
def bcubed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.bcubed(table(spark, sf_dir, "documents"), "lang", "source")


@register("pairwise_prf", """WITH c AS (SELECT lang AS t, source AS p, count(*) AS n FROM documents GROUP BY ALL), x AS (SELECT sum(n * (n - 1) // 2) AS tp FROM c), y AS (SELECT sum(n * (n - 1) // 2) AS pp FROM (SELECT sum(n) AS n FROM c GROUP BY p)), z AS (SELECT sum(n * (n - 1) // 2) AS tt FROM (SELECT sum(n) AS n FROM c GROUP BY t))
SELECT CAST(tp AS BIGINT) AS tp, CAST(pp - tp AS BIGINT) AS fp, CAST(tt - tp AS BIGINT) AS fn FROM x, y, z""")
def pairwise_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.pairwise(table(spark, sf_dir, "documents"), "lang", "source")


@register("label_pr", f"""{P} SELECT count_if(p = 0 AND conf >= 0.5 AND t = 0) AS tp, CAST(count_if(p = 0 AND conf >= 0.5 AND t = 0) AS DOUBLE) / nullif(count_if(p = 0 AND conf >= 0.5), 0) AS precision, CAST(count_if(p = 0 AND conf >= 0.5 AND t = 0) AS DOUBLE) / nullif(count_if(t = 0), 0) AS recall FROM p""")
def label_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit, is_it = (F.col("p") == 0) & (F.col("conf") >= 0.5), F.col("t") == 0
    c = _predicted(spark, sf_dir).agg(F.count_if(hit & is_it).alias("tp"), F.count_if(hit).alias("hits"), F.count_if(is_it).alias("all"))
    return c.select("tp", ev.ratio(F.col("tp"), F.col("hits")).alias("precision"), ev.ratio(F.col("tp"), F.col("all")).alias("recall"))


@register("micro_average", "WITH e AS (SELECT lang, length(text) AS n, length(text) - length(replace(text, 'e', '')) AS err FROM documents) SELECT lang, CAST(sum(err) AS DOUBLE) / nullif(sum(n), 0) AS rate FROM e GROUP BY lang")
def micro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    sums = table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(n - F.length(F.replace("text", F.lit("e"), F.lit("")))).alias("a"), F.sum(n).alias("b"))
    return sums.select("lang", ev.ratio(F.col("a"), F.col("b")).alias("rate"))


@register("weighted_median", f"""{W}, s AS (SELECT day, user_id, sum(e - s) AS w FROM iv GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY day ORDER BY user_id) AS c, sum(w) OVER (PARTITION BY day) AS t FROM s) SELECT day, min(user_id) AS weighted_median FROM c WHERE c * 2 >= t GROUP BY day""")
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.weighted_median(intervals(spark, sf_dir).withColumn("w", F.col("end") - F.col("start")), ["day"], "user_id", "w")


@register("weighted_mean", "SELECT event_type, CASE WHEN sum(user_id) > 0 THEN sum(user_id * value) / sum(user_id) ELSE 0.0 END AS mean FROM events WHERE value IS NOT NULL GROUP BY event_type")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "events").filter("value is not null").groupBy("event_type").agg(F.sum(F.col("user_id") * F.col("value")).alias("a"), F.sum("user_id").alias("b"))
    return sums.select("event_type", F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(0.0).alias("mean"))


@register("token_confidence_stats", f"""{W} SELECT user_id, avg(p) AS avg_p, avg(CASE WHEN p < 0.5 THEN 1.0 ELSE 0.0 END) AS low_share, min(s) FILTER (p >= 0.6) AS first_sure, max(e) FILTER (p >= 0.6) AS last_sure FROM (SELECT *, (id % 100) / 100.0 AS p FROM iv) GROUP BY user_id""")
def token_confidence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    rows = intervals(spark, sf_dir).withColumn("p", (F.col("id") % 100) / 100.0)
    return rows.groupBy("user_id").agg(F.avg("p").alias("avg_p"), F.avg(F.when(p < 0.5, 1.0).otherwise(0.0)).alias("low_share"), F.min(F.when(p >= 0.6, F.col("start"))).alias("first_sure"), F.max(F.when(p >= 0.6, F.col("end"))).alias("last_sure"))


@register("group_bytes", "SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY source")
def group_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes")).orderBy(F.desc("bytes"), "source")


@register("field_counts", "SELECT coalesce(nullif(CASE WHEN n_chars % 5 = 0 THEN '' ELSE lang END, ''), 'unknown') AS field, count(*) AS n FROM documents GROUP BY 1")
def field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = F.when(F.col("n_chars") % 5 == 0, "").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").groupBy(F.coalesce(F.nullif(field, F.lit("")), F.lit("unknown")).alias("field")).agg(F.count("*").alias("n"))


_PRIORITY = "n_chars + 10 * (doc_id % 10) + CASE WHEN lang = 'en' THEN 100 ELSE 70 END"


def _priority() -> Column:
    return F.col("n_chars") + 10 * (F.col("doc_id") % 10) + F.when(F.col("lang") == "en", 100).otherwise(70)


@register("top_k_per_group", f"SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {_PRIORITY} DESC, doc_id) AS rank FROM documents) WHERE rank <= 5")
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.top_per_group(table(spark, sf_dir, "documents"), ["source"], [_priority().desc(), F.col("doc_id")], 5).select("source", "doc_id", "rank")


@register("decision_conflict", "WITH d AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 'drop' ELSE 'keep' END AS x, CAST(ts AS DATE) AS day FROM events) SELECT event_id, CASE WHEN x = 'drop' AND count_if(x <> 'drop') OVER (PARTITION BY user_id) > 0 THEN 'needs_review' ELSE x END AS settled FROM d")
def decision_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").withColumn("decision", F.when(F.col("event_type") == "error", "drop").otherwise("keep"))
    return rv.settle_conflicts(d, "user_id", "decision").select("event_id", "settled")


@register("check", f"""{W}, m AS (SELECT day, count(*) AS n, avg(e - s) AS mean FROM iv GROUP BY day) SELECT day, 'enough_events' AS id, 'hard' AS severity, CASE WHEN n >= 30 THEN 'pass' ELSE 'fail' END AS status, CAST(n AS DOUBLE) AS observed FROM m UNION ALL SELECT day, 'short_events', 'soft', CASE WHEN mean < 60000 THEN 'pass' ELSE 'fail' END, mean FROM m""")
def check(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = intervals(spark, sf_dir).groupBy("day").agg(F.count("*").alias("n"), F.avg(F.col("end") - F.col("start")).alias("mean"))
    return rv.check_rows(m, [("enough_events", "hard", F.col("n") >= 30, F.col("n")), ("short_events", "soft", F.col("mean") < 60_000, F.col("mean"))]).select("day", "id", "severity", "status", "observed")


@register("baseline_compare", """WITH c AS (SELECT source AS metric, avg(n_chars) AS value FROM documents WHERE doc_id % 2 = 0 GROUP BY source), b AS (SELECT source AS metric, avg(n_chars) AS base FROM documents WHERE doc_id % 2 = 1 GROUP BY source)
SELECT metric AS id, CASE WHEN base IS NULL THEN 'soft' ELSE 'hard' END AS severity, CASE WHEN base IS NULL THEN 'warn' WHEN value >= base * 0.9 THEN 'pass' ELSE 'fail' END AS status, value AS observed, base * 0.9 AS threshold FROM c LEFT JOIN b USING (metric)""")
def baseline_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    now, before = (d.filter(F.col("doc_id") % 2 == k).groupBy(F.col("source").alias("metric")).agg(F.avg("n_chars").alias("value")) for k in (0, 1))
    return ev.baseline_compare(now, before, F.lit(True), 0.1)


@register("identity_diff_join", """WITH x AS (SELECT doc_id AS path, n_chars AS bytes, md5(text) AS h FROM documents), a AS (SELECT path, bytes + CASE WHEN path % 11 = 0 THEN 1 ELSE 0 END AS b, CASE WHEN path % 13 = 0 THEN 'x' ELSE h END AS s FROM x WHERE path % 7 <> 0)
SELECT path, CASE WHEN b IS NULL THEN 'missing' WHEN bytes <> b THEN 'size_changed' ELSE 'sha256_changed' END AS problem FROM x LEFT JOIN a USING (path) WHERE b IS NULL OR bytes <> b OR h <> s""")
def identity_diff_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("bytes"), F.md5("text").alias("sha256"))
    now = x.filter("path % 7 <> 0").select("path", (F.col("bytes") + F.when(F.col("path") % 11 == 0, 1).otherwise(0)).alias("bytes"), F.when(F.col("path") % 13 == 0, "x").otherwise(F.col("sha256")).alias("sha256"))
    return rv.identity_diff(x, now)


@register("anti_already_in_base", "SELECT DISTINCT event_id FROM events e WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'view' AND b.user_id = e.user_id AND floor(b.value) = floor(e.value))")
def anti_already_in_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.floor("value"))
    return e.filter("event_type = 'click'").join(e.filter("event_type = 'view'"), ["user_id", "k"], "left_anti").select("event_id").distinct()


@register("cosine", "SELECT a.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", tx.cosine(F.col("embedding"), F.col("other")).alias("cosine"))


@register("rms_db", "SELECT vec_id, round(greatest(10 * log10(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) / len(embedding)), -120), 3) AS db FROM embeddings")
def rms_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", tx.level_db(F.col("embedding")).alias("db"))


@register("rule_cross_join", "SELECT a, b, count(*) AS n, count_if(n_chars > a AND doc_id % 10 < b) AS hits FROM documents, (VALUES (500), (1000), (2000)) x(a), (VALUES (2), (5)) y(b) GROUP BY ALL")
def rule_cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (500, 1000, 2000) for b in (2, 5)]))
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", grid.alias("g"))
    return d.groupBy("g.a", "g.b").agg(F.count("*").alias("n"), F.count_if((F.col("n_chars") > F.col("g.a")) & (F.col("doc_id") % 10 < F.col("g.b"))).alias("hits"))


@register("json_scan", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.from_json("props", "k bigint")["k"].alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@register("dedupe_key", "SELECT min(doc_id) AS doc_id, source, lang, n_chars // 100 AS size FROM documents GROUP BY ALL")
def dedupe_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", "lang", F.expr("n_chars div 100").alias("size")).agg(F.min("doc_id").alias("doc_id"))


@register("percentile_linear", "SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, max(value) AS top FROM events GROUP BY event_type")
def percentile_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return ev.percentiles(e, ["event_type"], "value", {"p50": 0.5, "p90": 0.9}).join(e.groupBy("event_type").agg(F.max("value").alias("top")), "event_type")


@register("lifecycle_percentiles", "WITH s AS (SELECT user_id, CASE WHEN event_type = 'signup' THEN value END AS v FROM events) SELECT user_id, coalesce(quantile_cont(v, 0.5), 0.0) AS p50, coalesce(quantile_cont(v, 0.95), 0.0) AS p95 FROM s GROUP BY user_id")
def lifecycle_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear percentiles of the values there are; 0 for a key without any."""
    rows = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_type") == "signup", F.col("value")))
    return rows.select("user_id").distinct().join(ev.percentiles(rows, ["user_id"], "v", {"p50": 0.5, "p95": 0.95}), "user_id", "left").fillna(0.0, ["p50", "p95"])


@register("metric_median", f"{W}, m AS (SELECT day, median(e - s) AS m FROM iv GROUP BY day) SELECT day, median(abs(e - s - m)) AS mad FROM iv JOIN m USING (day) GROUP BY day")
def metric_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir).select("day", (F.col("end") - F.col("start")).cast("double").alias("x"))
    away = rows.join(ev.percentiles(rows, ["day"], "x", {"m": 0.5}), "day").select("day", F.abs(F.col("x") - F.col("m")).alias("x"))
    return ev.percentiles(away, ["day"], "x", {"mad": 0.5})


@register("corpus_rollup", """SELECT source, count(*) AS sessions, count_if(lang = 'en') AS n_en, count_if(quality = 1) AS good, count_if(quality = 0) AS bad, CAST(coalesce(sum(n_chars) FILTER (quality = 0), 0) AS BIGINT) AS bad_chars, CAST(sum(n_chars) AS BIGINT) AS chars, median(CAST(n_chars AS DOUBLE)) AS median_chars, count(DISTINCT lang) AS languages,
 (list(doc_id ORDER BY doc_id) FILTER (quality = 0))[:10] AS first_risks FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def corpus_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums by verdict with unlabelled rows left out of both, the median size, and the first ten sessions at risk."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("size", F.col("n_chars").cast("double"))
    bad = F.col("quality") == 0
    sums = rows.groupBy("source").agg(F.count("*").alias("sessions"), F.count_if(F.col("lang") == "en").alias("n_en"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(bad).alias("bad"), F.coalesce(F.sum(F.when(bad, F.col("n_chars"))), F.lit(0)).alias("bad_chars"), F.sum("n_chars").alias("chars"), F.countDistinct("lang").alias("languages"))
    first = rv.top_per_group(rows.filter(bad), ["source"], [F.col("doc_id")], 10).groupBy("source").agg(F.sort_array(F.collect_list("doc_id")).alias("first_risks"))
    return sums.join(ev.percentiles(rows, ["source"], "size", {"median_chars": 0.5}), "source", "left").join(first, "source", "left")


@register("content_hash_agg", "SELECT source, doc_id // 1000 AS inventory, sha256(string_agg('doc/' || doc_id || chr(0) || n_chars || chr(10), '' ORDER BY 'doc/' || doc_id)) AS fingerprint FROM documents GROUP BY ALL")
def content_hash_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 over path NUL bytes LF in path order, for inventories of at most 1000 files of a source."""
    files = table(spark, sf_dir, "documents").select("source", F.expr("doc_id div 1000").alias("inventory"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("bytes"))
    return rv.inventory_fingerprint(files, ["source", "inventory"])


@register("even_sample", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT DISTINCT source, doc_id FROM r, range(0, 5) k(k) WHERE i = CAST(floor(k * (n - 1) / 4.0) AS BIGINT)")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.even_sample(table(spark, sf_dir, "documents"), ["source"], "doc_id", 5).select("source", "doc_id")


@register("centroid", """WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings), m AS (SELECT label, i - 1 AS i, avg(CAST(v AS DOUBLE)) AS m FROM x GROUP BY ALL)
SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS mean FROM m""")
def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", F.posexplode("centroid").alias("i", "mean")).withColumn("i", F.col("i").cast("long"))


_NEAR = """WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings), m AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM x GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label),
s AS (SELECT vec_id, e.label AS own, c.label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), c) AS sim FROM embeddings e, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS r, lead(sim) OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS second FROM s)"""


@register("nearest_centroid", _NEAR + " SELECT vec_id, CASE WHEN sim >= 0.1 AND sim - coalesce(second, 0) >= 0.02 THEN label END AS assigned FROM r WHERE r = 1")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return ev.nearest_centroid(e, ev.centroids(e, "label", "embedding"), "label", "embedding", 0.1, 0.02).select("vec_id", "assigned")


@register("cluster_stats", _NEAR + """, o AS (SELECT own, vec_id, sim FROM s WHERE own = label) SELECT own AS label, count(*) AS units, CAST(min(vec_id) AS BIGINT) AS first, CAST(max(vec_id) AS BIGINT) AS last, round(median(sim), 6) AS cohesion_median, round(quantile_cont(sim, 0.1), 6) AS cohesion_p10 FROM o GROUP BY own""")
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and span of clusters, and how near their members are to the centroid."""
    e = table(spark, sf_dir, "embeddings")
    return ev.cluster_stats(e, "label", "embedding", "vec_id")


@register("major_cluster_filter", _NEAR + ", o AS (SELECT own, vec_id, sim FROM s WHERE own = label) SELECT own AS label FROM o GROUP BY own HAVING count(*) >= 10 AND max(vec_id) - min(vec_id) >= 60 AND round(median(sim), 6) >= 0.05")
def major_cluster_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with enough units, span and cohesion."""
    return cluster_stats(spark, sf_dir).filter((F.col("units") >= 10) & (F.col("last") - F.col("first") >= 60) & (F.col("cohesion_median") >= 0.05)).select("label")


@register("speaker_assign", _NEAR + """, o AS (SELECT own, count(*) AS units FROM s WHERE own = label GROUP BY own), a AS (SELECT s.vec_id, s.own, max(sim) FILTER (own = label) AS sim, max(sim) FILTER (own <> label AND label IN (SELECT own FROM o WHERE units >= 10)) AS other FROM s GROUP BY 1, 2),
p AS (SELECT vec_id, own, CASE WHEN vec_id % 11 = 0 THEN 'not_an_embedding_unit' WHEN units < 10 THEN 'minor_or_unstable_cluster' WHEN sim < 0.2 THEN 'low_cluster_similarity' WHEN sim - coalesce(other, 0) < 0.02 THEN 'low_cluster_margin' ELSE 'stable_anonymous_cluster' END AS reason FROM a JOIN o USING (own)),
q AS (SELECT *, CASE WHEN reason = 'stable_anonymous_cluster' THEN own END AS sp FROM p), f AS (SELECT x.vec_id AS a, y.vec_id AS b FROM q x JOIN q y ON y.vec_id = x.vec_id + 1 AND x.vec_id % 3 = 0 WHERE x.sp <> y.sp), cf AS (SELECT a AS id FROM f UNION SELECT b FROM f)
SELECT vec_id, CASE WHEN id IS NULL THEN sp END AS speaker, CASE WHEN id IS NULL THEN reason ELSE 'possible_remote_double_talk' END AS reason FROM q LEFT JOIN cf ON id = vec_id""")
def speaker_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors to the speakers of their clusters; both sides of an overlap of two speakers go back together."""
    e = table(spark, sf_dir, "embeddings").withColumn("is_unit", F.col("vec_id") % 11 != 0)
    pairs = e.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    return ev.assign_speakers(e, "vec_id", "label", "embedding", pairs, least_units=10, similarity=0.2, margin=0.02)


@register("target_voice_score", "SELECT a.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS target FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2")
def target_voice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity to the voice less that to its contrast."""
    a = table(spark, sf_dir, "embeddings")
    b, c = (a.select((F.col("vec_id") - k).alias("vec_id"), F.col("embedding").alias(n)) for k, n in ((1, "positive"), (2, "negative")))
    return a.join(b, "vec_id").join(c, "vec_id").select("vec_id", tx.target_score(F.col("embedding"), F.col("positive"), F.col("negative")).alias("target"))


@register("decision_dialogue_join", r"""WITH d AS (SELECT event_id AS decision, unnest([user_id % 50, user_id % 50 + event_id % 3]) AS turn FROM events WHERE event_type <> 'view'), t AS (SELECT turn, min(text) AS text, min(role) AS role FROM conversations GROUP BY turn),
e AS (SELECT DISTINCT d.decision, d.turn, CASE WHEN d.decision % 7 = 0 THEN t.text || ' !' WHEN d.decision % 11 = 0 THEN 'other' ELSE t.text END AS text, CASE WHEN d.decision % 5 = 0 THEN 'Unknown' WHEN d.decision % 13 = 0 THEN 'nobody' ELSE t.role END AS role FROM d LEFT JOIN t USING (turn))
SELECT decision, bool_and(coalesce(trim(regexp_replace(regexp_replace(lower(t.text), '[^\p{L}\p{N}+/-]+', ' ', 'g'), ' +', ' ', 'g')) = trim(regexp_replace(regexp_replace(lower(e.text), '[^\p{L}\p{N}+/-]+', ' ', 'g'), ' +', ' ', 'g')) AND (e.role = 'Unknown' OR e.role = t.role), FALSE)) AS matches FROM e LEFT JOIN t USING (turn) GROUP BY decision""")
def decision_dialogue_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions whose turns are all in the dialogue still, with the text and the role that they were made on."""
    d = table(spark, sf_dir, "events").filter("event_type <> 'view'").select(F.col("event_id").alias("decision"), F.explode(F.expr("array(user_id % 50, user_id % 50 + event_id % 3)")).alias("turn")).distinct()
    t = table(spark, sf_dir, "conversations").groupBy("turn").agg(F.min("text").alias("text"), F.min("role").alias("role"))
    seen = F.when(F.col("decision") % 7 == 0, F.concat("text", F.lit(" !"))).when(F.col("decision") % 11 == 0, "other").otherwise(F.col("text"))
    role = F.when(F.col("decision") % 5 == 0, "Unknown").when(F.col("decision") % 13 == 0, "nobody").otherwise(F.col("role"))
    evidence = d.join(t, "turn", "left").select("decision", "turn", seen.alias("text"), role.alias("role"))
    return rv.decisions_match(evidence, t, "decision", "turn")


@register("confidence_histogram", f"""{P} SELECT CASE WHEN conf < 0.6 THEN '[0,0.6)' WHEN conf < 0.75 THEN '[0.6,0.75)' WHEN conf < 0.9 THEN '[0.75,0.9)' ELSE '[0.9,1]' END AS bucket, count(*) AS items, avg(CASE WHEN p = t THEN 1.0 ELSE 0.0 END) AS accuracy, avg(CASE WHEN (p = 0) = (t = 0) OR lang = 'de' THEN 1.0 ELSE 0.0 END) AS loose_accuracy, count_if(p <> t) AS errors, count_if(p = 0) AS said_0, count_if(p = 1) AS said_1 FROM p GROUP BY ALL""")
def confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf, wrong, said = F.col("conf"), F.col("p") != F.col("t"), F.col("p")
    bucket = rv.ladder("[0.9,1]", (conf < 0.6, "[0,0.6)"), (conf < 0.75, "[0.6,0.75)"), (conf < 0.9, "[0.75,0.9)"))
    share = [F.avg(F.when(c, 0.0).otherwise(1.0)).alias(n) for c, n in ((wrong, "accuracy"), (wrong & (F.col("lang") != "de"), "loose_accuracy"))]
    return _predicted(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("items"), *share, F.count_if(wrong).alias("errors"), F.count_if(said == 0).alias("said_0"), F.count_if(said == 1).alias("said_1"))


@register("taxonomy_rollup", """WITH m AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r FROM m), k AS (SELECT source, CAST(sum(n) AS BIGINT) AS items, count(*) AS classes, max(lang) FILTER (r = 1) AS mode FROM r GROUP BY source),
d AS (SELECT source, CAST(sum(n_chars) AS BIGINT) AS seconds, count(DISTINCT doc_id // 10) AS sessions, count_if(quality = 0) AS attention, (list(doc_id ORDER BY doc_id) FILTER (quality = 0))[:5] AS first_attention FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source) SELECT * FROM k JOIN d USING (source)""")
def taxonomy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, seconds, sessions and classes of a group, its commonest class (ties: first), and the first five rows that need attention."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    m = rows.groupBy("source", "lang").agg(F.count("*").alias("n"))
    k = m.groupBy("source").agg(F.sum("n").alias("items"), F.count("*").alias("classes"), F.min_by("lang", F.struct(-F.col("n"), F.col("lang"))).alias("mode"))
    d = rows.groupBy("source").agg(F.sum("n_chars").alias("seconds"), F.countDistinct(F.expr("doc_id div 10")).alias("sessions"), F.count_if(F.col("quality") == 0).alias("attention"))
    first = rv.top_per_group(rows.filter("quality = 0"), ["source"], [F.col("doc_id")], 5).groupBy("source").agg(F.sort_array(F.collect_list("doc_id")).alias("first_attention"))
    return k.join(d, "source", "left").join(first, "source", "left")


@register("progress_rollup", """SELECT lang, count(*) AS total, count_if(quality IS NOT NULL) AS reviewed, CAST(sum(n_chars) AS BIGINT) AS seconds, CAST(sum(CASE WHEN quality IS NULL THEN n_chars ELSE 0 END) AS BIGINT) AS remaining_seconds, count(*) - count_if(quality IS NOT NULL) AS remaining, CAST(count_if(quality IS NOT NULL) AS DOUBLE) / count(*) AS ratio,
 count_if(quality = 1) AS keep, count_if(quality = 0) AS "drop" FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def progress_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rv.progress(rows, "lang", F.col("quality").isNotNull(), "n_chars", {"keep": F.col("quality") == 1, "drop": F.col("quality") == 0})


@register("cluster_purity", f"""{P}, c AS (SELECT source AS cluster, t, sum(n_chars) AS w FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY w DESC, t) AS r, sum(w) OVER (PARTITION BY cluster) AS total FROM c)
SELECT cluster, CAST(total AS BIGINT) AS total, t AS dominant, CAST(w AS DOUBLE) / total AS dominant_share FROM r WHERE r = 1""")
def cluster_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.purity(_predicted(spark, sf_dir), "t", "source", "n_chars")


_ALIGNED = "a AS (SELECT lang AS speaker, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE source END AS cluster, n_chars AS words, doc_id % 4 <> 0 AS matched FROM documents)"


@register("purity_report", f"""WITH {_ALIGNED}, ref AS (SELECT speaker, sum(words) AS n FROM a GROUP BY speaker), tot AS (SELECT sum(words) AS all_words, sum(words) FILTER (matched) AS matched_words FROM a), m AS (SELECT speaker, cluster, sum(words) AS w FROM a WHERE matched GROUP BY ALL), sp AS (SELECT speaker, sum(w) AS total FROM m GROUP BY speaker),
att AS (SELECT * FROM m WHERE cluster IS NOT NULL), dom AS (SELECT cluster, max(w) AS w FROM att GROUP BY cluster), first AS (SELECT cluster, speaker FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY w DESC, speaker) AS r FROM att) WHERE r = 1),
top AS (SELECT speaker, cluster FROM (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY w DESC, cluster) AS r FROM att) WHERE r = 1), col AS (SELECT cluster FROM top JOIN sp USING (speaker) WHERE total >= 5 GROUP BY cluster HAVING count(*) > 1),
spl AS (SELECT speaker FROM att JOIN sp USING (speaker) WHERE w >= 5 AND CAST(w AS DOUBLE) / greatest(1, total) >= 0.15 GROUP BY speaker HAVING count(*) > 1), mino AS (SELECT speaker, n FROM ref, tot WHERE CAST(n AS DOUBLE) / greatest(1, all_words) <= 0.05)
SELECT CAST(matched_words AS DOUBLE) / all_words AS alignment, (SELECT CAST(sum(w) AS DOUBLE) FROM dom) / (SELECT sum(w) FROM att) AS purity, (SELECT count(*) FROM col) AS collisions, (SELECT count(*) FROM spl) AS split_speakers, (SELECT count(*) FROM mino) AS minority,
 (SELECT CAST(sum(att.w) AS DOUBLE) FROM att JOIN first USING (cluster, speaker) JOIN mino USING (speaker)) / (SELECT nullif(sum(n), 0) FROM mino) AS minority_recall,
 CASE WHEN CAST(matched_words AS DOUBLE) / all_words < 0.55 THEN 'EVIDENCE_BOUND' WHEN (SELECT count(*) FROM col) > 0 OR (SELECT count(*) FROM ref) > 3 THEN 'ADVANCE_SEGMENTATION' WHEN (SELECT CAST(sum(w) AS DOUBLE) FROM dom) / (SELECT sum(w) FROM att) < 0.95 THEN 'ADVANCE_USABILITY_GATE' ELSE 'EVIDENCE_BOUND' END AS route FROM tot""")
def purity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How pure published clusters are against reference speakers, with collisions, split and minority speakers and what to do next."""
    a = table(spark, sf_dir, "documents").select(F.col("lang").alias("speaker"), F.when(F.col("doc_id") % 10 != 0, F.col("source")).alias("cluster"), F.col("n_chars").alias("words"), (F.col("doc_id") % 4 != 0).alias("matched"))
    return ev.purity_report(a, published=3)


@register("map_distribution", "SELECT source, string_agg(lang || '=' || n, ',' ORDER BY lang) AS distribution FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def map_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by class of each group as one sorted map."""
    m = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("lang", "n")))
    return m.groupBy("source").agg(F.array_join(F.transform(entries, lambda x: F.concat_ws("=", x["lang"], x["n"].cast("string"))), ",").alias("distribution"))


@register("null_skipping_mean", "SELECT user_id, avg(CASE WHEN event_id % 3 = 0 THEN value END) AS mean FROM events GROUP BY user_id")
def null_skipping_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(F.when(F.col("event_id") % 3 == 0, F.col("value"))).alias("mean"))


@register("distinct_count", "SELECT source, count(DISTINCT lang) AS languages, count(DISTINCT n_chars) AS sizes FROM documents GROUP BY source")
def distinct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.countDistinct("lang").alias("languages"), F.countDistinct("n_chars").alias("sizes"))


@register("peak_db", "SELECT vec_id, round(20 * log10(list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) + 1e-12), 3) AS db FROM embeddings")
def peak_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", tx.peak_db(F.col("embedding")).alias("db"))


@register("zero_lag_corr", """WITH p AS (SELECT a.vec_id, unnest(list_zip(a.embedding, b.embedding)) AS z FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(abs(corr(CAST(z[1] AS DOUBLE), CAST(z[2] AS DOUBLE))), 9) AS corr FROM p GROUP BY vec_id""")
def zero_lag_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute Pearson correlation of two signals as far as both go; 0 for flat or short ones."""
    a = table(spark, sf_dir, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(tx.zero_lag_corr(F.col("embedding"), F.col("other"), least=32), 9).alias("corr"))


@register("align_constant", "SELECT vec_id, list_concat([0e0, 0e0, 0e0], CAST(embedding[:len(embedding) - 3] AS DOUBLE[])) AS shifted FROM embeddings")
def align_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal moved by three samples, zeros in front."""
    return table(spark, sf_dir, "embeddings").select("vec_id", tx.shifted(F.col("embedding"), 3).cast("array<double>").alias("shifted"))


@register("vad_ratio", "WITH f AS (SELECT vec_id, i, 10 * log10(list_sum(list_transform(embedding[i * 16 + 1:i * 16 + 16], lambda x: CAST(x AS DOUBLE) * x)) / 16 + 1e-12) >= -18 AS raw, 10 * log10(list_sum(list_transform(embedding[i * 16 + 1:i * 16 + 16], lambda x: CAST(x AS DOUBLE) * x / 2)) / 16 + 1e-12) >= -18 AS clean FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 16)) AS i FROM embeddings)) SELECT vec_id, CASE WHEN count_if(raw) = 0 THEN 1.0 ELSE CAST(count_if(clean) AS DOUBLE) / count_if(raw) END AS ratio FROM f GROUP BY vec_id")
def vad_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with sound in a cleaned signal, against the raw one; 1 if that is silent."""
    e = table(spark, sf_dir, "embeddings")
    clean = F.transform("embedding", lambda x: x.cast("double") / F.sqrt(F.lit(2.0)))
    return e.select("vec_id", tx.vad_ratio(F.col("embedding"), clean, 16, -18.0).alias("ratio"))


@register("unique_topk", "WITH r AS (SELECT doc_id, source, lang, n_chars, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) SELECT doc_id, source, lang FROM r WHERE r = 1 ORDER BY n_chars DESC, doc_id LIMIT 12")
def unique_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best row of each signature, then the best of these."""
    return rv.unique_topk(table(spark, sf_dir, "documents"), ["source", "lang"], [F.desc("n_chars"), F.col("doc_id")], 12).select("doc_id", "source", "lang")


@register("item_limit", "WITH u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, lang, n_chars ORDER BY doc_id) AS u FROM documents) WHERE u = 1), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM u) SELECT doc_id FROM r WHERE r <= 4 ORDER BY n_chars DESC, doc_id LIMIT 25")
def item_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a key, the best few of each label, then the best of these."""
    one = rv.top_per_group(table(spark, sf_dir, "documents"), ["source", "lang", "n_chars"], [F.col("doc_id")], 1)
    order = [F.desc("n_chars"), F.col("doc_id")]
    return rv.top_per_group(one, ["source"], order, 4).orderBy(*order).limit(25).select("doc_id")


@register("profile_priority_pick", "SELECT user_id, coalesce(max(event_type) FILTER (event_type = 'purchase' AND value > 100), max(event_type) FILTER (event_type = 'signup' AND value > 50), max(event_type) FILTER (event_type = 'click'), 'current') AS profile FROM events GROUP BY user_id")
def profile_priority_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first profile of a cascade that is there and passes its gate; each falls through to the next."""
    kind, value = F.col("event_type"), F.col("value")
    return rv.first_profile(table(spark, sf_dir, "events"), "user_id", [("purchase", (kind == "purchase") & (value > 100)), ("signup", (kind == "signup") & (value > 50)), ("click", kind == "click")], "current")


@register("absent_identity_check", "SELECT doc_id AS path FROM documents WHERE doc_id % 3 = 0 AND doc_id IN (SELECT doc_id FROM labels)")
def absent_identity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that should be gone but are there."""
    gone = table(spark, sf_dir, "documents").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("path"))
    return gone.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path")), "path", "left_semi")


@register("equi_lookup_join", "SELECT e.event_id, a.role AS left_role, b.role AS right_role FROM events e JOIN conversations a ON a.conv_id = e.user_id AND a.turn = 0 JOIN conversations b ON b.conv_id = e.user_id AND b.turn = e.event_id % 4 WHERE a.role <> b.role")
def equi_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps with both of their turns, where the roles differ."""
    e, c = table(spark, sf_dir, "events"), table(spark, sf_dir, "conversations")
    left = c.filter("turn = 0").select(F.col("conv_id").alias("user_id"), F.col("role").alias("left_role"))
    right = c.select(F.col("conv_id").alias("user_id"), F.col("turn").cast("long").alias("k"), F.col("role").alias("right_role"))
    both = e.select("event_id", "user_id", (F.col("event_id") % 4).alias("k")).join(left, "user_id").join(right, ["user_id", "k"])
    return both.filter("left_role <> right_role").select("event_id", "left_role", "right_role")


@register("dedupe_first", "SELECT conv_id, len(list_distinct(list_filter(list_transform(string_split(text, ' '), lambda x: trim(x)), lambda x: x <> ''))) AS n, list_filter(list_transform(string_split(text, ' '), lambda x: trim(x)), lambda x: x <> '')[1] AS first FROM conversations WHERE turn = 0")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different strings in the order of their first use, trimmed and without empty ones."""
    own = tx.dedupe_strings(F.split("text", " "))
    return table(spark, sf_dir, "conversations").filter("turn = 0").select("conv_id", F.size(own).cast("long").alias("n"), F.get(own, F.lit(0)).alias("first"))


@register("candidate_union", "WITH a AS (SELECT user_id AS id, 0 AS side, min(event_id) AS e FROM events WHERE event_type = 'click' GROUP BY user_id), b AS (SELECT user_id, 1, max(event_id) FROM events WHERE event_type = 'view' GROUP BY user_id), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT id, side, e FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY side DESC) AS r FROM u) WHERE r = 1")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of candidates after each other; of one id the last wins."""
    e = table(spark, sf_dir, "events")
    a = e.filter("event_type = 'click'").groupBy(F.col("user_id").alias("id")).agg(F.min("event_id").alias("e"))
    b = e.filter("event_type = 'view'").groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("e"))
    return rv.last_wins([a, b], "id", "side")
