"""Queries of interval algebra and time joins, each with independent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.operators import intervals as iv
from colloquy.plans.registry import register
from colloquy.plans.views import INTERVALS_SQL, TURNS_SQL, intervals, turns

W = f"WITH {INTERVALS_SQL}"
WT = f"WITH {TURNS_SQL}"
BUCKET = 60_000


def _track(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return intervals(spark, sf_dir).filter(F.col("track").isin(*names))


@register("interval_union_length", f"""{W}, o AS (SELECT day, s, e, max(e) OVER (PARTITION BY day ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT day, CAST(sum(len) AS BIGINT) AS union_length FROM (SELECT day, g, max(e) - min(s) AS len FROM g GROUP BY day, g) GROUP BY day""")
def interval_union_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.union_length(intervals(spark, sf_dir), ["day"])


@register("gap_sessionize", f"""{W}, o AS (SELECT user_id, s, e, max(e) OVER (PARTITION BY user_id ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
g AS (SELECT *, sum(CASE WHEN s > reach + 1800000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT user_id, min(s) AS "start", max(e) AS "end", count(*) AS n FROM g GROUP BY user_id, g""")
def gap_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.merge(intervals(spark, sf_dir), ["user_id"], gap=1_800_000).drop("island")


@register("token_gap_split", f"""{W}, o AS (SELECT day, track, id, s, e, max(e) OVER (PARTITION BY day, track ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv)
SELECT id, CAST(sum(CASE WHEN s >= reach + 1500 THEN 1 ELSE 0 END) OVER (PARTITION BY day, track ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chunk FROM o""")
def token_gap_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.islands(intervals(spark, sf_dir), ["day", "track"], 1500, strict=True, order=("id",)).select("id", F.col("island").alias("chunk"))


_SWEEP = """, edges AS (SELECT day, s AS t, 1 AS a, 0 AS b FROM {a} UNION ALL SELECT day, e, -1, 0 FROM {a} UNION ALL SELECT day, s, 0, 1 FROM {b} UNION ALL SELECT day, e, 0, -1 FROM {b}),
net AS (SELECT day, t, sum(a) AS a, sum(b) AS b FROM edges GROUP BY day, t),
seg AS (SELECT day, t AS s, lead(t) OVER (PARTITION BY day ORDER BY t) AS e, sum(a) OVER (PARTITION BY day ORDER BY t) AS a, sum(b) OVER (PARTITION BY day ORDER BY t) AS b FROM net)"""
_A, _B = "(SELECT * FROM iv WHERE track = 'click')", "(SELECT * FROM iv WHERE track = 'view')"
_ISLAND = """, p AS (SELECT day, s, e, lag(e) OVER (PARTITION BY day ORDER BY s) AS pe FROM seg WHERE e IS NOT NULL AND {keep}),
q AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY s) AS g FROM p)
SELECT day, min(s) AS "start", max(e) AS "end" FROM q GROUP BY day, g HAVING max(e) - min(s) >= {least}"""


@register("interval_difference", W + _SWEEP.format(a=_A, b=_B) + _ISLAND.format(keep="a > 0 AND b = 0", least=350))
def interval_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.difference(_track(spark, sf_dir, "click"), _track(spark, sf_dir, "view"), ["day"], least=350)


@register("activity_jaccard", W + _SWEEP.format(a=_A, b=_B) + """ SELECT day, CASE WHEN sum(CASE WHEN a > 0 OR b > 0 THEN e - s ELSE 0 END) = 0 THEN 1.0 ELSE
 CAST(sum(CASE WHEN a > 0 AND b > 0 THEN e - s ELSE 0 END) AS DOUBLE) / sum(CASE WHEN a > 0 OR b > 0 THEN e - s ELSE 0 END) END AS jaccard FROM seg WHERE e IS NOT NULL GROUP BY day""")
def activity_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = iv.intersection_and_union(_track(spark, sf_dir, "click"), _track(spark, sf_dir, "view"), ["day"])
    return parts.select("day", F.when(F.col("either") == 0, 1.0).otherwise(F.col("both") / F.col("either")).alias("jaccard"))


_FRAME = "(SELECT day, min(s) AS s, max(e) AS e FROM iv GROUP BY day)"
_GUARDED = "(SELECT day, s - 150 AS s, e + 200 AS e FROM iv WHERE track = 'view')"


@register("free_intervals", W + _SWEEP.format(a=_FRAME, b=_GUARDED) + _ISLAND.format(keep="a > 0 AND b = 0", least=0))
def free_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = intervals(spark, sf_dir).groupBy("day").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return iv.complement(_track(spark, sf_dir, "view"), ["day"], frame, before=150, after=200)


@register("interval_union_coverage", f"""{W}, c AS (SELECT c.id, c.s AS cs, c.e AS ce, greatest(c.s, v.s) AS s, least(c.e, v.e) AS e FROM iv c JOIN iv v ON v.track = 'view' AND c.s < v.e AND c.e > v.s WHERE c.track = 'click'),
o AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT id, least(1.0, CAST(sum(len) AS DOUBLE) / greatest(1, any_value(d))) AS coverage FROM (SELECT id, g, max(e) - min(s) AS len, any_value(ce - cs) AS d FROM g GROUP BY id, g) GROUP BY id""")
def interval_union_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = iv.overlap_join(_track(spark, sf_dir, "click"), _track(spark, sf_dir, "view"), [], BUCKET)
    parts = pairs.select("l.id", (F.col("l.end") - F.col("l.start")).alias("d"), F.greatest("l.start", "r.start").alias("start"), F.least("l.end", "r.end").alias("end"))
    return iv.union_length(parts, ["id", "d"]).select("id", F.least(F.lit(1.0), F.col("union_length") / F.greatest("d", F.lit(1))).alias("coverage"))


@register("state_intervals", f"""{W}, f AS (SELECT day, min(s) + 3600000 AS fs, min(s) + 36000000 AS fe FROM iv GROUP BY day), c AS (SELECT day, greatest(s, fs) AS s, least(e, fe) AS e FROM iv JOIN f USING (day) WHERE track IN ('click', 'view') AND s < fe AND e > fs),
o AS (SELECT *, max(e) OVER (PARTITION BY day ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT day, min(s) AS "start", max(e) AS "end" FROM g GROUP BY day, g HAVING max(e) - min(s) >= 350""")
def state_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir)
    frame = rows.groupBy("day").agg((F.min("start") + 3_600_000).alias("_fs"), (F.min("start") + 36_000_000).alias("_fe"))
    inside = iv.clip(_track(spark, sf_dir, "click", "view").join(frame, "day"), F.col("_fs"), F.col("_fe"))
    return iv.merge(inside, ["day"]).filter(F.col("end") - F.col("start") >= 350).select("day", "start", "end")


@register("interval_intersection", f"{W} SELECT id FROM iv a WHERE track = 'purchase' AND EXISTS (SELECT 1 FROM iv b WHERE b.track = 'error' AND b.s < a.e AND b.e > a.s)")
def interval_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.overlap_join(_track(spark, sf_dir, "purchase"), _track(spark, sf_dir, "error"), [], BUCKET, "left_semi").select("id")


@register("tumbling_overlap_windows", f"""{W}, f AS (SELECT day, min(s) AS s, max(e) AS e FROM iv GROUP BY day), w AS (SELECT day, s, e, unnest(range(0, CAST(ceil((e - s) / 60000.0) AS BIGINT))) AS i FROM f)
SELECT day, i AS index, s + i * 60000 AS hard_start, least(s + i * 60000 + 60000, e) AS hard_end, greatest(s + i * 60000 - 5000, s) AS clip_start, least(least(s + i * 60000 + 60000, e) + 5000, e) AS clip_end FROM w""")
def tumbling_overlap_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = intervals(spark, sf_dir).groupBy("day").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return iv.tumbling(frame, ["day"], 60_000, 5_000)


@register("sliding_windows", f"""{W}, b AS (SELECT id, s, e, CASE WHEN e - s >= 20000 THEN (e - s - 20000) // 10000 + 1 ELSE 0 END AS n FROM iv), f AS (SELECT id, s + unnest(range(0, n)) * 10000 AS ws, e FROM b WHERE n > 0),
t AS (SELECT id, greatest(e - 20000, s) AS ws, e FROM b WHERE CASE WHEN n > 0 THEN e - s - ((n - 1) * 10000 + 20000) ELSE e - s END >= 1000)
SELECT id, ws AS "start", least(ws + 20000, e) AS "end" FROM (SELECT * FROM f UNION ALL SELECT * FROM t)""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.sliding(intervals(spark, sf_dir), ["id"], 20_000, 10_000, 1_000).drop("index")


@register("center_in_window_assign", f"{W} SELECT day, ((s + e) // 2) // 60000 AS window_index, count(*) AS n FROM iv GROUP BY ALL")
def center_in_window_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals(spark, sf_dir).groupBy("day", F.expr("((start + end) div 2) div 60000").alias("window_index")).agg(F.count("*").alias("n"))


@register("run_length_turns", f"""{W}, o AS (SELECT *, CASE WHEN lag(track) OVER w IS NOT DISTINCT FROM track AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM iv WINDOW w AS (PARTITION BY day ORDER BY s, id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY day ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT day, CAST(g AS BIGINT) AS run, any_value(track) AS track, count(*) AS n, min(s) AS first, max(s) AS last FROM g GROUP BY day, g""")
def run_length_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.runs(intervals(spark, sf_dir), ["day"], ["start", "id"], "track")


@register("zero_runs", f"""{W}, m AS (SELECT user_id, s, e - s < 10000 AS quiet, row_number() OVER (PARTITION BY user_id ORDER BY s, id) - row_number() OVER (PARTITION BY user_id, e - s < 10000 ORDER BY s, id) AS g FROM iv)
SELECT user_id, min(s) AS first, max(s) AS last, count(*) AS n FROM m WHERE quiet GROUP BY user_id, g HAVING count(*) >= 3""")
def zero_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = intervals(spark, sf_dir).withColumn("quiet", F.col("end") - F.col("start") < 10_000)
    return iv.runs(marked, ["user_id"], ["start", "id"], "quiet").filter("quiet and n >= 3").select("user_id", "first", "last", "n")


@register("isolation_lag_lead", f"""{W} SELECT id FROM (SELECT id, s - lag(e) OVER w AS before, lead(s) OVER w - e AS after FROM iv WINDOW w AS (PARTITION BY day, track ORDER BY s, id)) WHERE coalesce(before, 8000) >= 8000 AND coalesce(after, 8000) >= 8000""")
def isolation_lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = iv.lagged(intervals(spark, sf_dir), ["day", "track"], ["start", "id"], {"_end": "end"}, {"_start": "start"})
    gaps = near.select("id", (F.col("start") - F.col("_end")).alias("before"), (F.col("_start") - F.col("end")).alias("after"))
    return gaps.filter((F.coalesce("before", F.lit(8000)) >= 8000) & (F.coalesce("after", F.lit(8000)) >= 8000)).select("id")


@register("lag_order_inversion", f"{W} SELECT id, p AS previous_start FROM (SELECT id, s, lag(s) OVER (PARTITION BY user_id ORDER BY e, id) AS p FROM iv) WHERE s + 1000 < p")
def lag_order_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = iv.lagged(intervals(spark, sf_dir), ["user_id"], ["end", "id"], {"previous_start": "start"})
    return rows.filter(F.col("start") + 1000 < F.col("previous_start")).select("id", "previous_start")


@register("self_overlap_pairs", f"{W} SELECT a.id AS left_id, b.id AS right_id FROM iv a JOIN iv b ON a.track = 'view' AND b.track = 'view' AND a.id < b.id AND least(a.e, b.e) - greatest(a.s, b.s) >= 500")
def self_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _track(spark, sf_dir, "view")
    enough = iv.overlap(F.col("l.start"), F.col("l.end"), F.col("r.start"), F.col("r.end")) >= 500
    return iv.overlap_join(rows, rows, [], BUCKET).filter((F.col("l.id") < F.col("r.id")) & enough).select(F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"))


@register("overlap_flag_map", f"""{W}, p AS (SELECT a.id AS x, b.id AS y FROM iv a JOIN iv b ON a.track = 'view' AND b.track = 'view' AND a.id <> b.id AND least(a.e, b.e) - greatest(a.s, b.s) >= 500) SELECT x AS id, string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) AS partners FROM p GROUP BY x""")
def overlap_flag_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = self_overlap_pairs(spark, sf_dir)
    both = p.select(F.col("left_id").alias("id"), F.col("right_id").alias("y")).unionAll(p.select("right_id", "left_id"))
    return both.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("y")), lambda y: y.cast("string")), ",").alias("partners"))


@register("interval_overlap_agg_join", f"""{W}, p AS (SELECT u.id, s.track, sum(least(u.e, s.e) - greatest(u.s, s.s)) AS ms FROM iv u JOIN iv s ON s.s < u.e AND s.e > u.s AND s.id <> u.id WHERE u.track = 'signup' GROUP BY ALL)
SELECT id, track, CAST(ms AS DOUBLE) / sum(ms) OVER (PARTITION BY id) AS ratio FROM p""")
def interval_overlap_agg_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = iv.overlap_join(_track(spark, sf_dir, "signup"), intervals(spark, sf_dir), [], BUCKET).filter("l.id <> r.id")
    ms = iv.overlap(F.col("l.start"), F.col("l.end"), F.col("r.start"), F.col("r.end"))
    by = pairs.groupBy("l.id", "r.track").agg(F.sum(ms).alias("ms"))
    whole = F.sum("ms").over(Window.partitionBy("id"))
    return by.select("id", "track", F.when(whole == 0, F.lit(float("nan"))).otherwise(F.col("ms") / whole).alias("ratio"))


@register("support_bounds_join", f"""{W} SELECT u.id, min(greatest(u.s, s.s)) FILTER (s.id IS NOT NULL) AS support_start, max(least(u.e, s.e)) FILTER (s.id IS NOT NULL) AS support_end, coalesce(CAST(sum(least(u.e, s.e) - greatest(u.s, s.s)) FILTER (s.id IS NOT NULL) AS BIGINT), 0) AS support_ms FROM iv u LEFT JOIN iv s ON s.track = 'view' AND least(u.e, s.e) - greatest(u.s, s.s) >= 500 WHERE u.track = 'signup' GROUP BY u.id""")
def support_bounds_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _track(spark, sf_dir, "signup")
    start, end = F.greatest("l.start", "r.start"), F.least("l.end", "r.end")
    support = iv.overlap_join(rows, _track(spark, sf_dir, "view"), [], BUCKET).filter(end - start >= 500).groupBy("l.id").agg(F.min(start).alias("support_start"), F.max(end).alias("support_end"), F.sum(end - start).alias("support_ms"))
    return rows.select("id").join(support, "id", "left").withColumn("support_ms", F.coalesce("support_ms", F.lit(0)))


@register("action_coverage_filter", f"""{W} SELECT u.id FROM iv u JOIN iv s ON s.s < u.e AND s.e > u.s AND s.track <> 'signup' WHERE u.track = 'signup' GROUP BY u.id, u.s, u.e HAVING bool_and(s.track IN ('view', 'click')) AND sum(least(u.e, s.e) - greatest(u.s, s.s)) >= u.e - u.s - 50""")
def action_coverage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = iv.overlap_join(_track(spark, sf_dir, "signup"), intervals(spark, sf_dir).filter("track <> 'signup'"), [], BUCKET)
    ms = iv.overlap(F.col("l.start"), F.col("l.end"), F.col("r.start"), F.col("r.end"))
    by = pairs.groupBy("l").agg(F.bool_and(F.col("r.track").isin("view", "click")).alias("allowed"), F.sum(ms).alias("ms"))
    return by.filter(F.col("allowed") & (F.col("ms") >= F.col("l.end") - F.col("l.start") - 50)).select("l.id")


@register("point_in_interval_join", f"{W} SELECT c.id, count(*) AS n FROM iv c JOIN iv v ON v.track = 'view' AND (c.s + c.e) // 2 BETWEEN v.s - 500 AND v.e + 500 WHERE c.track = 'click' GROUP BY c.id")
def point_in_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    middle = F.expr("(start + end) div 2")
    points = _track(spark, sf_dir, "click").withColumn("end", middle + 1).withColumn("start", F.col("end") - 1)
    wide = _track(spark, sf_dir, "view").withColumn("start", F.col("start") - 500).withColumn("end", F.col("end") + 501)
    return iv.overlap_join(points, wide, [], BUCKET).groupBy("l.id").agg(F.count("*").alias("n"))


@register("nearest_join", f"""{W}, c AS (SELECT id, day, (s + e) // 2 AS m FROM iv WHERE track = 'purchase'), v AS (SELECT id, day, (s + e) // 2 AS m FROM iv WHERE track = 'error')
SELECT id, near_id, distance FROM (SELECT c.id, v.id AS near_id, abs(c.m - v.m) AS distance, row_number() OVER (PARTITION BY c.id ORDER BY abs(c.m - v.m), v.m, v.id) AS r FROM c CROSS JOIN v) WHERE r = 1""")
def nearest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = (_track(spark, sf_dir, t).select("id", "day", F.expr("(start + end) div 2").alias("m")) for t in ("purchase", "error"))
    found = iv.nearest(left, right, [], "m", "id").filter("near is not null")
    return found.select("id", F.col("near.id").alias("near_id"), F.abs(F.col("m") - F.col("near.m")).alias("distance"))


@register("cumulative_order_windows", f"""{W}, b AS (SELECT day, (s // 3600000) AS block, min(s) AS bs, max(e) AS be FROM iv GROUP BY ALL) SELECT i.id, min(b.block) AS block FROM iv i JOIN b ON i.day = b.day AND i.s BETWEEN b.bs AND b.be GROUP BY i.id""")
def cumulative_order_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir)
    blocks = rows.groupBy("day", F.expr("start div 3600000").alias("block")).agg(F.min("start").alias("start"), (F.max("end") + 1).alias("end"))
    points = rows.select("id", "day", "start", (F.col("start") + 1).alias("end"))
    return iv.overlap_join(points, blocks, ["day"], 600_000).groupBy("l.id").agg(F.min("r.block").alias("block"))


@register("review_clusters", f"""{W}, f AS (SELECT * FROM iv WHERE track IN ('error', 'purchase')), o AS (SELECT *, max(e) OVER (PARTITION BY day ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f),
g AS (SELECT *, sum(CASE WHEN s > reach + 4000 THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT day, count(*) AS items, string_agg(DISTINCT track, ',' ORDER BY track) AS labels, max(e - s) AS priority, greatest(min(s) - 2000, 0) AS listen_start, max(e) + 2000 AS listen_end FROM g GROUP BY day, g""")
def review_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = iv.islands(_track(spark, sf_dir, "error", "purchase"), ["day"], 4000, order=("id",))
    labels = F.array_join(F.sort_array(F.collect_set("track")), ",").alias("labels")
    out = marked.groupBy("day", "island").agg(F.count("*").alias("items"), labels, F.max(F.col("end") - F.col("start")).alias("priority"), F.greatest(F.min("start") - 2000, F.lit(0)).alias("listen_start"), (F.max("end") + 2000).alias("listen_end"))
    return out.drop("island")


@register("group_pair_pivot_join", f"""{WT} SELECT session, turn // 2 AS chunk, max(text) FILTER (track = 'mic') AS mic, max(text) FILTER (track = 'remote') AS remote FROM turns GROUP BY ALL HAVING mic IS NOT NULL AND remote IS NOT NULL""")
def group_pair_pivot_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    def side(track: str) -> DataFrame:
        return turns(spark, sf_dir).filter(F.col("track") == track).groupBy("session", F.expr("turn div 2").alias("chunk")).agg(F.max("text").alias(track))

    return side("mic").join(side("remote"), ["session", "chunk"])


@register("raw_commit_scan", f"""{WT} SELECT session, chunk, track, turn FROM (SELECT session, turn // 2 AS chunk, track, turn, row_number() OVER (PARTITION BY session, turn // 2, track ORDER BY turn DESC) AS r FROM turns WHERE track IN ('mic', 'remote')) WHERE r = 1""")
def raw_commit_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = turns(spark, sf_dir).filter(F.col("track").isin("mic", "remote"))
    return kept.groupBy("session", F.expr("turn div 2").alias("chunk"), "track").agg(F.max("turn").alias("turn"))
