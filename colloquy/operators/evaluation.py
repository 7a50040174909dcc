"""Evaluation: multiset overlap, partitions against truth, weighted statistics, gates against a baseline."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from colloquy.functions import text as tx
from colloquy.operators.intervals import with_carry
from colloquy.operators.joins import null_safe


def multiset_prf(rows: DataFrame, key: list[str], left: str, right: str) -> DataFrame:
    """key, both, recall (of left), precision (of right), f1 of two token arrays as multisets; null ratios where a side is empty. Row by row, without a shuffle."""
    rows = rows.withColumn("_a", tx.elements(F.col(left))).withColumn("_b", tx.elements(F.col(right)))
    out = rows.select(*key, F.size(left).alias("_l"), F.size(right).alias("_r"), F.size(F.array_intersect("_a", "_b")).cast("long").alias("both"))
    recall, precision = F.when(F.col("_l") > 0, F.col("both") / F.col("_l")), F.when(F.col("_r") > 0, F.col("both") / F.col("_r"))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).when(precision + recall == 0, 0.0)
    return out.select(*key, "both", recall.alias("recall"), precision.alias("precision"), f1.alias("f1"))


def contingency(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """truth, predicted, n: all that partition metrics need, however many rows there are."""
    return rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))


def bcubed(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """precision, recall, f1: mean over items of the share of their cluster, and class, that is of their kind."""
    c = contingency(rows, truth, predicted)
    c = c.withColumn("tn", F.sum("n").over(Window.partitionBy("t"))).withColumn("pn", F.sum("n").over(Window.partitionBy("p")))
    sums = c.agg(F.sum(F.col("n") * F.col("n") / F.col("pn")).alias("a"), F.sum(F.col("n") * F.col("n") / F.col("tn")).alias("b"), F.sum("n").alias("z"))
    return sums.select((F.col("a") / F.col("z")).alias("precision"), (F.col("b") / F.col("z")).alias("recall"), (2 * F.col("a") * F.col("b") / F.col("z") / (F.col("a") + F.col("b"))).alias("f1"))


def pairwise(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """tp, fp, fn over all pairs of items, from cell counts."""
    c = contingency(rows, truth, predicted)

    def pairs(frame: DataFrame, name: str) -> DataFrame:
        return frame.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias(name))

    both = pairs(c, "tp").join(pairs(c.groupBy("p").agg(F.sum("n").alias("n")), "pp"), how="cross").join(pairs(c.groupBy("t").agg(F.sum("n").alias("n")), "tt"), how="cross")
    return both.select("tp", (F.col("pp") - F.col("tp")).alias("fp"), (F.col("tt") - F.col("tp")).alias("fn"))


def purity(rows: DataFrame, truth: str, predicted: str, weight: str) -> DataFrame:
    """predicted, total, dominant (ties: smaller truth), dominant_share by weight."""
    c = rows.groupBy(F.col(predicted).alias("cluster"), F.col(truth).alias("t")).agg(F.sum(weight).alias("w"))
    top = F.struct(F.col("w"), (-F.col("t")).alias("k"))
    out = c.groupBy("cluster").agg(F.sum("w").alias("total"), F.max(top).alias("m"))
    return out.select("cluster", "total", (-F.col("m.k")).alias("dominant"), (F.col("m.w") / F.col("total")).alias("dominant_share"))


#: Parts that a key's values are cut into at each narrowing; two narrowings leave a four-thousandth of them.
PARTS = 64


def weighted_median(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """by, weighted_median: the first value whose cumulative weight reaches half. Null values are left out, null keys are keys.

    Twice, the values are cut at quantiles into parts of about as many rows, and only the part where half is reached goes on,
    with the weight before it; so no task sorts a key, wherever its values lie.
    """
    sums = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    total = sums.groupBy(*by).agg(F.sum("_w").alias("_t"))
    left = null_safe(sums, total, by).withColumn("_before", F.lit(0).cast(sums.schema["_w"].dataType))
    for _ in range(2):
        edges = left.groupBy(*by).agg(F.percentile_approx(value, [k / PARTS for k in range(1, PARTS)], 1000).alias("_e"))
        parted = null_safe(left, edges, by).withColumn("_k", F.size(F.filter("_e", lambda e: e < F.col(value)))).drop("_e")
        per = parted.groupBy(*by, "_k").agg(F.sum("_w").alias("_p"), F.first("_before").alias("_o"), F.first("_t").alias("_u"))
        w = Window.partitionBy(*by).orderBy("_k")  # PARTS rows at most
        run = F.col("_o") + F.sum("_p").over(w.rowsBetween(Window.unboundedPreceding, 0))
        reached = per.withColumn("_run", run).filter(F.col("_run") * 2 >= F.col("_u"))
        part = reached.groupBy(*by).agg(F.min(F.struct("_k", (F.col("_run") - F.col("_p")).alias("b"))).alias("_m"))
        left = null_safe(parted.drop("_before"), part, by).filter(F.col("_k") == F.col("_m._k")).withColumn("_before", F.col("_m.b")).drop("_m", "_k")
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    found = left.withColumn("_c", F.col("_before") + F.sum("_w").over(w))
    return found.filter(F.col("_c") * 2 >= F.col("_t")).groupBy(*by).agg(F.min(value).alias("weighted_median"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for b = 0."""
    return F.when(b != 0, a / b)


def baseline_compare(current: DataFrame, baseline: DataFrame, higher_is_better: Column, tolerance: float) -> DataFrame:
    """id, severity, status, observed, threshold for metric(metric, value) tables: worse than the baseline by more than a tolerance fails, no baseline warns."""
    both = current.join(baseline.select("metric", F.col("value").alias("base")), "metric", "left")
    threshold = F.when(higher_is_better, F.col("base") * (1 - tolerance)).otherwise(F.col("base") * (1 + tolerance))
    ok = F.when(higher_is_better, F.col("value") >= threshold).otherwise(F.col("value") <= threshold)
    status = F.when(F.col("base").isNull(), "warn").when(ok, "pass").otherwise("fail")
    return both.select(F.col("metric").alias("id"), F.when(F.col("base").isNull(), "soft").otherwise("hard").alias("severity"), status.alias("status"), F.col("value").alias("observed"), threshold.alias("threshold"))


#: A sketch's ranks are off by less than one in ACCURACY; twice that on either side surely holds the value.
ACCURACY = 10_000


def percentiles(rows: DataFrame, by: list[str], value: str, of: dict[str, float]) -> DataFrame:
    """by and exact percentiles {name: share}, linear between neighbours; nulls are left out, null keys are keys, and keys without values have no row.

    A mergeable sketch gives a bracket around each percentile; values below it are only counted, and those inside (a
    two-thousandth of the key's) are ranked in parts of the bracket. So no task gets a key's values, wherever an outlier lies.
    """
    some = rows.filter(F.col(value).isNotNull())
    around = [b for q in of.values() for b in (max(0.0, q - 2 / ACCURACY), min(1.0, q + 2 / ACCURACY))]
    sketch = some.groupBy(*by).agg(F.percentile_approx(value, around, ACCURACY).alias("_e"), F.count("*").alias("_t"))
    spread = null_safe(some.groupBy(*by, value).agg(F.count("*").alias("_n")), sketch, by)
    brackets = F.array(*[F.struct(F.lit(i).alias("q"), F.get("_e", F.lit(2 * i)).alias("lo"), F.get("_e", F.lit(2 * i + 1)).alias("hi"), ((F.col("_t") - 1) * F.lit(q)).alias("place")) for i, q in enumerate(of.values())])
    each = spread.select(*by, value, "_n", F.explode(brackets).alias("_b")).select(*by, value, "_n", "_b.*")
    v, under, over = F.col(value), F.col(value) < F.col("lo"), F.col(value) > F.col("hi")
    # a rank's neighbour may be the value next to the bracket
    sides = each.groupBy(*by, "q").agg(F.coalesce(F.sum(F.when(under, F.col("_n"))), F.lit(0)).alias("_below"), F.max(F.when(under, v)).alias("_prev"), F.min(F.when(over, v)).alias("_next"))
    inside = each.filter((F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi")))
    width = F.nullif((F.col("hi") - F.col("lo")).cast("double"), F.lit(0.0))
    inside = inside.withColumn("_k", F.coalesce(F.floor((F.col(value) - F.col("lo")).cast("double") / width * PARTS), F.lit(0)))
    inside = with_carry(inside, [*by, "q"], {"_before": (F.sum("_n"), F.sum)})
    run = Window.partitionBy(*by, "q", "_k").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    counted = null_safe(inside, sides, [*by, "q"]).withColumn("_c", F.col("_below") + F.coalesce("_before", F.lit(0)) + F.sum("_n").over(run))

    def at(place: Column) -> Column:
        return F.when(F.first("_below") > F.first(place), F.first("_prev")).otherwise(F.coalesce(F.min(F.when(F.col("_c") > place, v)), F.first("_next")))

    part = F.first(F.col("place") - F.floor("place"))
    found = counted.groupBy(*by, "q").agg(at(F.floor("place")).alias("lo"), at(F.ceil("place")).alias("hi"), part.alias("w"))
    found = found.withColumn("v", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("w"))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("q") == i, F.col("v"))).alias(n) for i, n in enumerate(of)])


def centroids(rows: DataFrame, by: str, embedding: str) -> DataFrame:
    """by and the mean vector of unit length."""
    x = rows.select(by, F.posexplode(embedding).alias("i", "v")).groupBy(by, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    mean = x.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))
    return mean.withColumn("centroid", tx.unit("centroid"))


#: Centroids that are compared with a batch of rows at once; bytes of centroids that may be sent to every task.
CENTROIDS_TOGETHER, SENT_BYTES = 4096, 32_000_000
_TOP = "_c1 {0}, _s1 double, _c2 {0}, _s2 double"


def _top_two(rows: DataFrame, blocks, by: str, embedding: str, kind: str) -> DataFrame:
    """rows with _c1, _s1, _c2, _s2: class and similarity of the nearest and the second nearest centroid of a block; ties by class.

    blocks gives, for a batch, (rows of it, classes, matrix of unit vectors) one after the other. Null, zero and non-finite
    vectors, and those of another dimension, have none.
    """
    at = rows.columns.index(embedding)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(at).cast(pa.list_(pa.float64()))
            n, sizes = batch.num_rows, pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
            top = [np.full((n, 2), -1, np.int64), np.full((n, 2), np.nan)]
            names: list = []
            for own, classes, centers in blocks(batch):
                fit = own[sizes[own] == centers.shape[1]]
                x = pc.list_flatten(vectors.take(pa.array(fit))).to_numpy(zero_copy_only=False).reshape(len(fit), -1)
                norm = np.linalg.norm(x, axis=1)
                good = np.isfinite(norm) & (norm > 0)
                fit, near = fit[good], (x[good] / norm[good, None]) @ centers.T
                for k in range(min(2, len(classes))):
                    best = near.argmax(1)
                    top[0][fit, k], top[1][fit, k] = best + len(names), near[np.arange(len(fit)), best]
                    near[np.arange(len(fit)), best] = -np.inf
                names += list(classes)
            classes = pa.array(names, batch_kind)
            columns = []
            for k in (0, 1):
                none = top[0][:, k] < 0
                columns += [classes.take(pa.array(top[0][:, k], mask=none)), pa.array(top[1][:, k], mask=none)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "_c1", "_s1", "_c2", "_s2"])

    batch_kind = to_arrow_type(T.DataType.fromDDL(kind))
    fields = [*rows.schema.fields, *T.StructType.fromDDL(_TOP.format(kind)).fields]
    return rows.mapInArrow(run, T.StructType(fields))


def _similarities(rows: DataFrame, centers: DataFrame, by: str, embedding: str) -> DataFrame:
    """rows with _c1, _s1, _c2, _s2 over all centroids, by one matrix product for a batch of rows and a block of centroids.

    Centroids whose size is checked to be small go to every task. More of them stay a table of blocks: rows meet block after
    block, and the best two of each block are merged.
    """
    kind = centers.schema[by].dataType.simpleString()
    size = centers.agg(F.count("*").alias("n"), F.max(F.size("centroid")).alias("d")).first()
    known = centers.filter(F.col("centroid").isNotNull()).select(F.col(by).alias("k"), F.col("centroid").alias("c"))
    if size["n"] * max(size["d"] or 0, 1) * 8 <= SENT_BYTES:
        held = sorted(known.collect(), key=lambda r: (r["k"] is None, r["k"]))
        classes, matrix = [r["k"] for r in held], np.array([r["c"] for r in held], float).reshape(len(held), -1)
        sent = rows.sparkSession.sparkContext.broadcast((classes, matrix))

        def whole(batch: pa.RecordBatch) -> Iterator[tuple]:
            if len(sent.value[0]):
                yield np.arange(batch.num_rows), *sent.value

        return _top_two(rows, whole, by, embedding, kind)
    many = -(-size["n"] // CENTROIDS_TOGETHER)
    blocks = known.groupBy(F.pmod(F.xxhash64("k"), F.lit(many)).cast("int").alias("_block")).agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("_all"))
    blocks = blocks.select("_block", F.transform("_all", lambda x: x["k"]).alias("_ks"), F.flatten(F.transform("_all", lambda x: x["c"])).alias("_cs"))
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    batched = numbered.groupBy(F.expr(f"_row div {CENTROIDS_TOGETHER}").alias("_batch")).agg(F.collect_list(F.struct(*numbered.columns)).alias("_rows"))
    met = batched.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))).join(blocks, "_block")
    each = met.select("_ks", "_cs", F.explode("_rows").alias("r")).select("r.*", "_ks", "_cs")

    def of_block(batch: pa.RecordBatch) -> Iterator[tuple]:
        ks, cs = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        starts = [0, *[i for i in range(1, batch.num_rows) if ks[i] != ks[i - 1]], batch.num_rows]
        for x, y in zip(starts[:-1], starts[1:], strict=True):
            if y > x:
                classes = ks[x].as_py()
                yield np.arange(x, y), classes, np.array(cs[x].as_py()).reshape(len(classes), -1)

    top = _top_two(each, of_block, by, embedding, kind).drop("_ks", "_cs")
    both = F.array(F.struct((-F.col("_s1")).alias("s"), F.col("_c1").alias("c")), F.struct((-F.col("_s2")).alias("s"), F.col("_c2").alias("c")))
    merged = top.groupBy("_row").agg(F.first(F.struct(*rows.columns)).alias("r"), F.slice(F.array_sort(F.filter(F.flatten(F.collect_list(both)), lambda x: x["s"].isNotNull())), 1, 2).alias("t"))
    best = [[F.get("t", F.lit(i))["c"].alias(f"_c{i + 1}"), (-F.get("t", F.lit(i))["s"]).alias(f"_s{i + 1}")] for i in (0, 1)]
    return merged.select("r.*", *best[0], *best[1])


def nearest_centroid(rows: DataFrame, centers: DataFrame, by: str, embedding: str, similarity: float, margin: float) -> DataFrame:
    """rows with `assigned`: the class of the nearest centroid if it is near enough and leads by the margin; a single centroid leads by its similarity. Rows without a usable vector have none."""
    near = _similarities(rows, centers, by, embedding)
    lead = F.col("_s1") - F.coalesce("_s2", F.lit(0.0))
    return near.withColumn("assigned", F.when((F.col("_s1") >= similarity) & (lead >= margin), F.col("_c1"))).select(*rows.columns, "assigned")


def _cohesion(rows: DataFrame, by: str, embedding: str) -> DataFrame:
    """rows with `similarity` to the centroid of their own class."""
    return rows.join(centroids(rows, by, embedding), by).withColumn("similarity", tx.dot(tx.unit(embedding), F.col("centroid"))).drop("centroid")


def cluster_stats(rows: DataFrame, by: str, embedding: str, at: str) -> DataFrame:
    """by, units, first, last, cohesion_median, cohesion_p10 of clusters."""
    near = _cohesion(rows, by, embedding)
    sums = near.groupBy(by).agg(F.count("*").alias("units"), F.min(at).cast("long").alias("first"), F.max(at).cast("long").alias("last"))
    spread = percentiles(near, [by], "similarity", {"cohesion_median": 0.5, "cohesion_p10": 0.1})
    return sums.join(spread.select(by, *[F.round(c, 6).alias(c) for c in ("cohesion_median", "cohesion_p10")]), by)


def assign_speakers(rows: DataFrame, key: str, by: str, embedding: str, overlaps: DataFrame, least_units: int, similarity: float, margin: float) -> DataFrame:
    """key, speaker and reason: members of large clusters that are near their centroid and not nearly as near to another large one's.

    Rows with is_unit false have no voice evidence. Of overlaps(a, b) between two speakers both sides lose theirs; all conflicts are found first.
    """
    large = rows.groupBy(by).count().filter(F.col("count") >= least_units).select(by)
    centers = centroids(rows, by, embedding)
    near = _similarities(rows, centers.join(large, by, "left_semi"), by, embedding)
    near = near.join(centers, by).withColumn("own", tx.dot(tx.unit(embedding), F.col("centroid")))
    near = null_safe(near, large.withColumn("_large", F.lit(True)), [by], "left")
    other = F.when(F.col("_c1") == F.col(by), F.col("_s2")).otherwise(F.col("_s1"))
    is_large = F.coalesce("_large", F.lit(False))
    reason = F.when(~F.col("is_unit"), "not_an_embedding_unit").when(~is_large, "minor_or_unstable_cluster").when(F.col("own") < similarity, "low_cluster_similarity")
    reason = reason.when(F.col("own") - F.coalesce(other, F.lit(0.0)) < margin, "low_cluster_margin").otherwise("stable_anonymous_cluster")
    first = near.select(key, F.col(by).alias("_by"), reason.alias("reason")).withColumn("speaker", F.when(F.col("reason") == "stable_anonymous_cluster", F.col("_by"))).drop("_by")
    said = first.filter("speaker is not null")
    a, b = (said.select(F.col(key).alias(s), F.col("speaker").alias(f"_{s}")) for s in "ab")
    both = overlaps.join(a, "a").join(b, "b").filter("_a <> _b")
    conflict = both.select(F.explode(F.array("a", "b")).alias(key)).distinct().withColumn("_conflict", F.lit(True))
    out = first.join(conflict, key, "left")
    return out.select(key, F.when(F.col("_conflict").isNull(), F.col("speaker")).alias("speaker"), F.when(F.col("_conflict").isNull(), F.col("reason")).otherwise("possible_remote_double_talk").alias("reason"))


def purity_report(aligned: DataFrame, published: int, least_words: int = 5, split_share: float = 0.15, minority_share: float = 0.05) -> DataFrame:
    """One row of figures for aligned(speaker, cluster or null, words, matched): all from the table of counts by speaker and cluster."""
    cells = aligned.groupBy("speaker", "cluster", "matched").agg(F.sum("words").alias("w"))
    reference = cells.groupBy("speaker").agg(F.sum("w").alias("n"), F.sum(F.when(F.col("matched"), F.col("w"))).alias("total"))
    totals = reference.agg(F.sum("n").alias("all"), F.sum("total").alias("matched"), F.count("*").alias("speakers"))
    found = cells.filter("matched and cluster is not null").groupBy("speaker", "cluster").agg(F.sum("w").alias("w"))

    def best(by: str, other: str) -> DataFrame:
        return found.groupBy(by).agg(F.max("w").alias("w"), F.min_by(other, F.struct(-F.col("w"), F.col(other))).alias(other))

    collisions = best("speaker", "cluster").join(reference, "speaker").filter(F.col("total") >= least_words).groupBy("cluster").count().filter("count > 1").agg(F.count("*").alias("collisions"))
    share = F.col("w") / F.greatest(F.lit(1), F.col("total"))
    split = found.join(reference, "speaker").filter((F.col("w") >= least_words) & (share >= split_share)).groupBy("speaker").count().filter("count > 1").agg(F.count("*").alias("split_speakers"))
    small = reference.join(F.broadcast(totals)).filter(F.col("n") / F.greatest(F.lit(1), F.col("all")) <= minority_share).select("speaker", "n")
    minority = small.agg(F.count("*").alias("minority"), F.sum("n").alias("minority_words"))
    kept = best("cluster", "speaker").join(small.select("speaker"), "speaker", "left_semi").agg(F.sum("w").alias("minority_kept"))
    dominant = best("cluster", "speaker").agg(F.sum("w").alias("dominant"))
    attributed = found.agg(F.sum("w").alias("attributed"))
    one = totals
    for part in (collisions, split, minority, kept, dominant, attributed):  # one row each
        one = one.join(F.broadcast(part))
    alignment, pure = F.col("matched") / F.col("all"), F.col("dominant") / F.col("attributed")
    route = F.when(alignment < 0.55, "EVIDENCE_BOUND").when((F.col("collisions") > 0) | (F.col("speakers") > published), "ADVANCE_SEGMENTATION").when(pure < 0.95, "ADVANCE_USABILITY_GATE").otherwise("EVIDENCE_BOUND")
    return one.select(alignment.alias("alignment"), pure.alias("purity"), "collisions", "split_speakers", "minority", (F.col("minority_kept") / F.col("minority_words")).alias("minority_recall"), route.alias("route"))
