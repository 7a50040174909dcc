"""Average linkage of cosine distances as a dendrogram, cut at any distance; replay by chunks; the choice of a distance.

The mean distance of two clusters of unit vectors is 1 less the product of their mean vectors, so a cluster is a sum of
vectors and a number of units, and no table of distances is kept. Clusters that are each other's nearest merge, all pairs of a
round at once: with average linkage no later merge could come between them, so the tree is that of merging one pair after the
other. Of equal distances (to twelve digits) the pair with the smaller first, then second, key is nearer.

Groups of up to `block` clusters are finished in one task. Larger ones go through rounds of tiles, which compare blocks of
clusters with each other and give each cluster's nearest one, until they are small enough.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators.evaluation import percentiles
from colloquy.storage import materialize

BLOCK = 1000
_PARENT = "unit bigint, into bigint, height double"


def _distances(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.round(1 - (a / n[:, None]) @ (b / m[:, None]).T, 12)


def merges(keys: np.ndarray, sums: np.ndarray, n: np.ndarray) -> list[tuple[int, int, float]]:
    """(key that ends, key that it joins, height) of all merges, of clusters in the order of their keys."""
    out, live = [], np.arange(len(keys))
    sums, n = sums.copy(), n.astype(float)
    far = _distances(sums, n, sums, n)
    np.fill_diagonal(far, np.inf)
    while len(live) > 1:
        near = far.argmin(1)
        own = np.arange(len(live))
        first = own[(near[near] == own) & (own < near)]
        second = near[first]
        out += [(int(keys[live[j]]), int(keys[live[i]]), float(far[i, j])) for i, j in zip(first, second, strict=True)]
        sums[live[first]] += sums[live[second]]
        n[live[first]] += n[live[second]]
        stay = np.ones(len(live), bool)
        stay[second] = False
        changed = (np.cumsum(stay) - 1)[first]
        live, far = live[stay], far[np.ix_(stay, stay)]
        new = _distances(sums[live[changed]], n[live[changed]], sums[live], n[live])
        far[changed], far[:, changed] = new, new.T
        far[np.arange(len(live)), np.arange(len(live))] = np.inf
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _kinds(rows: DataFrame, by: list[str]) -> str:
    return ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)


def _nearest(active: DataFrame, by: list[str], block: int) -> DataFrame:
    """by, unit and near: (distance, smaller key, larger key, the nearest cluster's key), compared in tiles of two blocks."""
    counts = active.groupBy(*by).agg(F.ceil(F.count("*") / (block / 2)).cast("int").alias("_b"))
    rows = active.join(counts, by).withColumn("_own", F.pmod(F.xxhash64("unit"), F.col("_b")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    rows = rows.withColumn("_tile", F.least("_own", "_other") * F.col("_b") + F.greatest("_own", "_other")).select(*by, "_tile", "unit", "n", "total", "_own")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("unit")
        keys, n, own, x = table["unit"].to_numpy(), table["n"].to_numpy().astype(float), table["_own"].to_numpy(), _matrix(table["total"])
        far = _distances(x, n, x, n)
        if own.min() != own.max():  # pairs inside a block have a tile of their own
            far[own[:, None] == own] = np.inf
        np.fill_diagonal(far, np.inf)
        near = far.argmin(1)
        d = far[np.arange(len(keys)), near]
        some = np.isfinite(d)
        cut = table.filter(pa.array(some)).select([*by, "unit"])
        return cut.append_column("d", pa.array(d[some])).append_column("other", pa.array(keys[near[some]]))

    found = rows.groupBy(*by, "_tile").applyInArrow(run, f"{_kinds(rows, by)}, unit bigint, d double, other bigint")
    return found.groupBy(*by, "unit").agg(F.min(F.struct("d", F.least("unit", "other").alias("lo"), F.greatest("unit", "other").alias("hi"), "other")).alias("near"))


def dendrogram(rows: DataFrame, by: list[str], key: str, embedding: str, block: int = BLOCK) -> DataFrame:
    """by, unit, into, height: the cluster that begins with unit ends in the one that begins with into, at that mean distance.

    Clusters are called by their smallest key, a whole number. Of rows with one key in a group, the first by vector counts;
    rows with a null key, or a null, empty or zero vector, take no part. Vectors of a group have one dimension.
    """
    unit = F.transform(embedding, lambda v: v.cast("double"))
    usable = rows.filter(F.col(key).isNotNull() & F.coalesce(F.exists(embedding, lambda v: v != 0), F.lit(False)))
    active = usable.groupBy(*by, F.col(key).cast("long").alias("unit")).agg(F.min(tx.unit(unit)).alias("total")).withColumn("n", F.lit(1).cast("long"))
    active, rounds = materialize(active, "units"), []
    while True:
        large = active.groupBy(*by).count().filter(F.col("count") > block).select(*by)
        if not large.limit(1).count():
            break
        near = materialize(_nearest(active.join(large, by, "left_semi"), by, block), "nearest")
        mine = near.select(*by, "unit", F.col("near.other").alias("partner"), F.col("near.d").alias("height")).filter("unit < partner")
        theirs = near.select(*by, F.col("unit").alias("partner"), F.col("near.other").alias("unit"))
        pairs = mine.join(theirs, [*by, "unit", "partner"])
        pairs = materialize(pairs, "pairs")
        rounds.append(pairs.select(*by, F.col("partner").alias("unit"), F.col("unit").alias("into"), "height"))
        gone = active.join(pairs.select(*by, F.col("partner").alias("unit"), F.col("unit").alias("_into")), [*by, "unit"]).select(*by, F.col("_into").alias("unit"), F.col("total").alias("_more"), F.col("n").alias("_n"))
        kept = active.join(pairs.select(*by, F.col("partner").alias("unit")), [*by, "unit"], "left_anti").join(gone, [*by, "unit"], "left")
        grown = F.when(F.col("_more").isNull(), F.col("total")).otherwise(F.zip_with("total", "_more", lambda a, b: a + b))
        active = materialize(kept.select(*by, "unit", grown.alias("total"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n")), "units")

    def finish(table: pa.Table) -> pa.Table:
        table = table.sort_by("unit")
        found = merges(table["unit"].to_numpy(), _matrix(table["total"]), table["n"].to_numpy())
        columns = [pa.array([table[c][0].as_py()] * len(found), table.schema.field(c).type) for c in by]
        parents = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
        return pa.table([*columns, *parents], names=[*by, "unit", "into", "height"])

    last = active.groupBy(*by).applyInArrow(finish, f"{_kinds(active, by)}, {_PARENT}")
    return reduce(DataFrame.unionByName, rounds, last)


def cut(units: DataFrame, parents: DataFrame, by: list[str], key: str, distances: list[float]) -> DataFrame:
    """by, key, distance, first: for each unit and each distance, the smallest key of the cluster that it is in when merges up to the distance are made.

    All distances go through the same joins: each unit points to the cluster that it ended in, and pointers are followed two
    steps at a time until none moves.
    """
    grid = F.explode(F.array(*map(F.lit, distances)))
    edges = materialize(parents.withColumn("distance", grid).filter(F.col("height") <= F.col("distance")).select(*by, "distance", "unit", "into"), "edges")
    at = units.select(*by, F.col(key).cast("long").alias("unit")).distinct().withColumn("distance", grid).withColumn("first", F.col("unit"))
    jump = edges
    while True:
        step = jump.select(*by, "distance", F.col("unit").alias("first"), F.col("into").alias("_to"))
        at = materialize(at.join(step, [*by, "distance", "first"], "left").select(*by, "distance", "unit", F.coalesce("_to", "first").alias("first"), F.col("_to").isNotNull().alias("moved")), "pointers")
        if not at.filter("moved").limit(1).count():
            return at.select(*by, F.col("unit").alias(key), "distance", "first")
        at = at.drop("moved")
        further = jump.select(*by, "distance", F.col("unit").alias("into"), F.col("into").alias("_to"))
        jump = materialize(jump.join(further, [*by, "distance", "into"], "left").select(*by, "distance", "unit", F.coalesce("_to", "into").alias("into")), "jumps")


def numbered(labels: DataFrame, by: list[str], name: str = "cluster") -> DataFrame:
    """labels with the numbers of their clusters, from 0 in the order of first, over the short list of clusters."""
    heads = labels.select(*by, "first").distinct().withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy("first")) - 1).cast("long"))
    return labels.join(heads, [*by, "first"]).drop("first")


def agglomerative(rows: DataFrame, by: str, key: str, embedding: str, distance: float = 0.20, block: int = BLOCK) -> DataFrame:
    """by, key, cluster of each group's units by average linkage up to the distance; numbers follow the first key. Units without a usable vector are clusters of their own."""
    labels = cut(rows.filter(F.col(key).isNotNull()), dendrogram(rows, [by], key, embedding, block), [by], key, [distance])
    return numbered(labels.drop("distance"), [by]).select(by, key, "cluster")


def centers(rows: DataFrame, keys: list[str], embedding: str) -> DataFrame:
    """keys and the mean of the unit vectors, of unit length."""
    each = rows.select(*keys, F.posexplode(tx.unit(F.transform(embedding, lambda v: v.cast("double")))).alias("_i", "_v")).groupBy(*keys, "_i").agg(F.avg("_v").alias("_m"))
    return each.groupBy(*keys).agg(tx.unit(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"])).alias("center"))


def chunk_replay(rows: DataFrame, by: list[str], key: str, chunk: str, embedding: str, distances: list[float], merge_distance: float, block: int = BLOCK) -> DataFrame:
    """by, key, distance, first: clusters as they come about when each chunk is clustered by itself, at each distance, and the chunks' clusters are merged by their centres."""
    own = [*by, chunk]
    local = cut(rows, dendrogram(rows, own, key, embedding, block), own, key, distances)
    local = materialize(local.withColumnRenamed("first", "_local"), "local")
    members = rows.select(*own, F.col(key).cast("long").alias(key), embedding).join(local, [*own, key])
    middle = materialize(centers(members, [*by, "distance", "_local"], embedding), "middle")
    middle = middle.withColumnRenamed("distance", "_at")
    found = cut(middle, dendrogram(middle, [*by, "_at"], "_local", "center", block), [*by, "_at"], "_local", [merge_distance])
    whole = found.drop("distance").withColumnRenamed("_at", "distance")
    return local.join(whole, [*by, "distance", "_local"]).select(*by, key, "distance", "first")


def cluster_figures(labels: DataFrame, rows: DataFrame, by: list[str], key: str, embedding: str, start: str, end: str) -> DataFrame:
    """by, distance, first, units, speech, span and cohesion (median similarity to the centre) of each cluster; start and end in seconds."""
    keys = [*by, "distance", "first"]
    members = labels.join(rows.select(*by, F.col(key).cast("long").alias(key), embedding, start, end), [*by, key])
    near = members.join(centers(members, keys, embedding), keys).withColumn("_s", tx.dot(tx.unit(F.transform(embedding, lambda v: v.cast("double"))), F.col("center")))
    sums = near.groupBy(*keys).agg(F.count("*").alias("units"), F.sum(F.col(end) - F.col(start)).alias("speech"), (F.max(end) - F.min(start)).alias("span"))
    return sums.join(percentiles(near, keys, "_s", {"cohesion": 0.5}), keys)


def adjusted_rand(rows: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """by, ari: how far two partitions agree beyond chance, from their contingency counts; 1 for one item or two trivial partitions."""
    cells = rows.groupBy(*by, F.col(left).alias("l"), F.col(right).alias("r")).agg(F.count("*").alias("n"))

    def pairs(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy(*by).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(name))

    a, b = (cells.groupBy(*by, c).agg(F.sum("n").alias("n")) for c in "lr")
    out = pairs(cells, "same").join(pairs(a, "a"), by).join(pairs(b, "b"), by).join(pairs(cells.groupBy(*by).agg(F.sum("n").alias("n")), "all"), by)
    expected, most = F.col("a") * F.col("b") / F.col("all"), (F.col("a") + F.col("b")) / 2
    return out.select(*by, F.when((F.col("all") == 0) | (most == expected), 1.0).otherwise((F.col("same") - expected) / (most - expected)).alias("ari"))


def consistency(labels: DataFrame, replay: DataFrame, by: list[str], key: str, major: DataFrame, replay_major: DataFrame) -> DataFrame:
    """by, distance, ari and coverage over units in major clusters of both partitions, counts of these, all_ari over all units. major tables: (by, distance, first)."""
    keys = [*by, "distance"]
    both = labels.join(replay.withColumnRenamed("first", "_r"), [*keys, key])
    both = both.join(major.select(*keys, "first", F.lit(True).alias("_m")), [*keys, "first"], "left").join(replay_major.select(*keys, F.col("first").alias("_r"), F.lit(True).alias("_n")), [*keys, "_r"], "left")
    both = materialize(both.select(*keys, key, "first", "_r", F.coalesce("_m", F.lit(False)).alias("_m"), F.coalesce("_n", F.lit(False)).alias("_n")), "both")
    share = both.groupBy(*keys).agg(F.count_if("_m").alias("_a"), F.count_if(F.col("_m") & F.col("_n")).alias("_b"), F.count("*").alias("_all"))
    counts = [t.groupBy(*keys).agg(F.count("*").alias(n)) for t, n in ((major, "whole_major"), (replay_major, "replay_major"))]
    out = share.join(adjusted_rand(both, keys, "first", "_r").withColumnRenamed("ari", "all_ari"), keys).join(adjusted_rand(both.filter("_m and _n"), keys, "first", "_r"), keys, "left")
    for c in counts:
        out = out.join(c, keys, "left")
    coverage = F.when(F.col("_a") > 0, F.col("_b") / F.col("_a")).otherwise(0.0)
    return out.select(*keys, F.when(F.col("_b") < 2, 0.0).otherwise(F.col("ari")).alias("ari"), coverage.alias("coverage"), F.coalesce("whole_major", F.lit(0)).alias("whole_major"), F.coalesce("replay_major", F.lit(0)).alias("replay_major"), "all_ari")


def partition_candidates(rows: DataFrame, by: str, key: str, embedding: str, start: str, end: str, distances: list[float], chunk_seconds: float = 600, merge_distance: float = 0.10, least: tuple[int, float, float, float] = (10, 60, 120, 0.5), block: int = BLOCK) -> DataFrame:
    """by, distance, clusters (major ones), speech_ratio, ari, coverage, count_match, reverse_ari, all_ari for each distance, from one dendrogram in each direction.

    least: units, seconds of speech, seconds from first to last, and cohesion of a major cluster.
    """
    rows = materialize(rows.select(by, F.col(key).cast("long").alias(key), embedding, start, end).withColumn("_chunk", F.floor(F.col(start) / chunk_seconds)), "rows")
    own, keys = [by], [by, "distance"]
    labels = materialize(cut(rows, dendrogram(rows, own, key, embedding, block), own, key, distances), "labels")
    turned = rows.withColumn(key, -F.col(key))
    back = cut(turned, dendrogram(turned, own, key, embedding, block), own, key, distances).withColumn(key, -F.col(key)).withColumnRenamed("first", "_r")
    reverse = adjusted_rand(labels.join(back, [*keys, key]), keys, "first", "_r").withColumnRenamed("ari", "reverse_ari")
    replay = materialize(chunk_replay(rows, own, key, "_chunk", embedding, distances, merge_distance, block), "replay")

    def majors(of: DataFrame) -> DataFrame:
        f = cluster_figures(of, rows, own, key, embedding, start, end)
        return materialize(f.filter((F.col("units") >= least[0]) & (F.col("speech") >= least[1]) & (F.col("span") >= least[2]) & (F.round("cohesion", 6) >= least[3])), "majors")

    whole, again = majors(labels), majors(replay)
    spoken = rows.groupBy(by).agg(F.sum(F.col(end) - F.col(start)).alias("_all"))
    speech = whole.groupBy(*keys).agg(F.sum("speech").alias("_speech"))
    out = consistency(labels, replay, own, key, whole, again).join(reverse, keys).join(spoken, by).join(speech, keys, "left")
    ratio = F.when(F.col("_all") > 0, F.coalesce("_speech", F.lit(0.0)) / F.col("_all")).otherwise(0.0)
    return out.select(*keys, F.col("whole_major").alias("clusters"), ratio.alias("speech_ratio"), "ari", "coverage", (F.col("whole_major") == F.col("replay_major")).alias("count_match"), "reverse_ari", "all_ari")


def viable(candidates: DataFrame, expected: str, speech: float = 0.55, ari: float = 0.90, coverage: float = 0.90) -> DataFrame:
    """candidates with `viable`: enough major clusters and speech, stable against order and chunks."""
    good = (F.col("clusters") >= F.col(expected)) & (F.col("speech_ratio") >= speech) & (F.round("reverse_ari", 6) >= 0.99) & (F.round("ari", 6) >= ari) & (F.col("coverage") >= coverage) & F.col("count_match")
    return candidates.withColumn("viable", good)
