"""Queries of decision ladders and scalar rules, each with independent SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.operators import intervals as iv
from colloquy.operators import review as rv
from colloquy.plans.registry import register
from colloquy.plans.views import INTERVALS_SQL, TURNS_SQL, intervals, table, turns

W = f"WITH {INTERVALS_SQL}"
WT = f"WITH {TURNS_SQL}"


def _share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, local, remote, double: shares of the user's time by kind of event."""
    size = F.col("end") - F.col("start")

    def part(*tracks: str) -> Column:
        return F.sum(F.when(F.col("track").isin(*tracks), size).otherwise(0)) / F.sum(size)

    return intervals(spark, sf_dir).groupBy("user_id").agg(part("click").alias("local"), part("view").alias("remote"), part("error", "signup").alias("double"))


_SHARE = "s AS (SELECT user_id, CAST(sum(CASE WHEN track = 'click' THEN e - s ELSE 0 END) AS DOUBLE) / sum(e - s) AS local, CAST(sum(CASE WHEN track = 'view' THEN e - s ELSE 0 END) AS DOUBLE) / sum(e - s) AS remote, CAST(sum(CASE WHEN track IN ('error', 'signup') THEN e - s ELSE 0 END) AS DOUBLE) / sum(e - s) AS dbl FROM iv GROUP BY user_id)"


def boundary(gap: Column, distance: Column, contrast: Column, edge: Column, valley: Column, pause: float, least: float) -> Column:
    """A long pause, or enough distance and contrast, or an utterance's edge in a silence; null features don't count."""
    far = F.coalesce((distance >= least) & (contrast >= least), F.lit(False))
    return F.coalesce(gap >= pause, F.lit(False)) | far | F.coalesce(edge & valley, F.lit(False))


_BOUNDARY = """b AS (SELECT id, coalesce(gap >= 600000, FALSE) OR coalesce(d >= 0.5 AND c >= 0.5, FALSE) OR coalesce(track = 'view' AND e - s < 5000, FALSE) AS found, user_id % 2 = 0 AS truth FROM
(SELECT *, s - lag(e) OVER (PARTITION BY day ORDER BY s, id) AS gap, CASE WHEN id % 5 = 0 THEN NULL ELSE (id % 10) / 10.0 END AS d, (id % 7) / 7.0 AS c FROM iv))"""


def _boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = iv.lagged(intervals(spark, sf_dir), ["day"], ["start", "id"], {"_end": "end"}).withColumn("gap", F.col("start") - F.col("_end"))
    distance = F.when(F.col("id") % 5 == 0, None).otherwise((F.col("id") % 10) / 10.0)
    found = boundary(F.col("gap"), distance, (F.col("id") % 7) / 7.0, F.col("track") == "view", F.col("end") - F.col("start") < 5000, 600_000, 0.5)
    return rows.select("id", found.alias("found"), (F.col("user_id") % 2 == 0).alias("truth"))


@register("boundary_detect", f"{W}, {_BOUNDARY} SELECT id, found FROM b")
def boundary_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boundaries(spark, sf_dir).select("id", "found")


@register("boundary_prf", f"{W}, {_BOUNDARY}, c AS (SELECT count_if(found AND truth) AS tp, count_if(found AND NOT truth) AS fp, count_if(NOT found AND truth) AS fn, count_if(NOT found AND NOT truth) AS tn FROM b) SELECT tp, fp, fn, tn, CASE WHEN tp + fp = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall FROM c")
def boundary_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, truth = F.col("found"), F.col("truth")
    c = _boundaries(spark, sf_dir).agg(F.count_if(found & truth).alias("tp"), F.count_if(found & ~truth).alias("fp"), F.count_if(~found & truth).alias("fn"), F.count_if(~found & ~truth).alias("tn"))
    return c.withColumn("precision", F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))).withColumn("recall", F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fn"))))


@register("temporal_similarity", f"""{WT} SELECT session, turn, CASE WHEN least(e, ne) > greatest(s, ns) THEN CAST(least(e, ne) - greatest(s, ns) AS DOUBLE) / greatest(1, least(e - s, ne - ns)) ELSE greatest(0.0, 1 - (greatest(s, ns) - least(e, ne)) / 12000.0) END AS similarity
FROM (SELECT *, lead(s, 2) OVER w AS ns, lead(e, 2) OVER w AS ne FROM turns WINDOW w AS (PARTITION BY session ORDER BY turn)) WHERE ns IS NOT NULL""")
def temporal_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap as a share of the shorter interval, or how near the other is, 0 from twelve seconds on."""
    w = Window.partitionBy("session").orderBy("turn")
    rows = turns(spark, sf_dir).withColumn("ns", F.lead("start", 2).over(w)).withColumn("ne", F.lead("end", 2).over(w)).filter("ns is not null")
    s, e, ns, ne = map(F.col, ("start", "end", "ns", "ne"))
    shared = iv.overlap(s, e, ns, ne)
    near = F.greatest(F.lit(0.0), 1 - (F.greatest(s, ns) - F.least(e, ne)) / 12000.0)
    return rows.select("session", "turn", F.when(shared > 0, shared / F.greatest(F.lit(1), F.least(e - s, ne - ns))).otherwise(near).alias("similarity"))


@register("eta", f"{W} SELECT day, CASE WHEN done > 0 THEN CAST(spent AS DOUBLE) / done * (n - done) END AS remaining FROM (SELECT day, count(*) AS n, count_if(track = 'click') AS done, sum(CASE WHEN track = 'click' THEN e - s ELSE 0 END) AS spent FROM iv GROUP BY day)")
def eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time spent per finished item times the items that remain; unknown before the first."""
    size = F.col("end") - F.col("start")
    by = intervals(spark, sf_dir).groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.col("track") == "click").alias("done"), F.sum(F.when(F.col("track") == "click", size).otherwise(0)).alias("spent"))
    return by.select("day", F.when(F.col("done") > 0, F.col("spent") / F.col("done") * (F.col("n") - F.col("done"))).alias("remaining"))


@register("incremental_invalidate", f"{W}, c AS (SELECT day, s // 60000 AS chunk, max(id % 97 = 0) AS changed FROM iv GROUP BY ALL), f AS (SELECT day, min(chunk) FILTER (changed) AS first FROM c GROUP BY day) SELECT day, chunk, CASE WHEN first IS NULL OR chunk < first THEN 'reuse' ELSE 'recompute' END AS plan FROM c JOIN f USING (day)")
def incremental_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks before the first changed one are reused, all from there on made again."""
    c = intervals(spark, sf_dir).groupBy("day", F.expr("start div 60000").alias("chunk")).agg(F.bool_or(F.col("id") % 97 == 0).alias("changed"))
    first = c.groupBy("day").agg(F.min(F.when(F.col("changed"), F.col("chunk"))).alias("first"))
    return c.join(first, "day").select("day", "chunk", F.when(F.col("first").isNull() | (F.col("chunk") < F.col("first")), "reuse").otherwise("recompute").alias("plan"))


@register("causal_target_me_lag", f"{W} SELECT id, max(e) OVER (PARTITION BY day) - e > 3600000 AS skipped FROM iv")
def causal_target_me_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional work is skipped for what lags behind the latest end by more than the budget; the row stays."""
    rows = intervals(spark, sf_dir)
    captured = rows.groupBy("day").agg(F.max("end").alias("captured"))
    return rows.join(captured, "day").select("id", (F.col("captured") - F.col("end") > 3_600_000).alias("skipped"))
