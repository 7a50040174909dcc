"""Speakers from voice vectors: consistency of clusterings, the choice of a distance, enrolment, and a trained judge of audio items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.decisions import label, num, yes
from colloquy.operators.joins import null_safe
from colloquy.operators.linkage import adjusted_rand
from colloquy.storage import materialize


def chunk_consistency(rows: DataFrame, by: str, left: str, right: str, least_units: int = 10) -> DataFrame:
    """by, ari and coverage of two clusterings over the units that are in large clusters of both; coverage is their share of those in large ones of the first."""

    def large(column: str, name: str) -> DataFrame:
        return rows.groupBy(by, column).agg((F.count("*") >= least_units).alias(name))

    both = rows.join(large(left, "_l"), [by, left]).join(large(right, "_r"), [by, right])
    shared = both.filter("_l and _r")
    share = both.groupBy(by).agg(F.count_if("_l").alias("_n"), F.count_if(F.col("_l") & F.col("_r")).alias("_m"))
    out = share.join(adjusted_rand(shared, [by], left, right), by, "left")
    return out.select(by, F.when(F.col("_m") < 2, 0.0).otherwise(F.col("ari")).alias("ari"), F.when(F.col("_n") > 0, F.col("_m") / F.col("_n")).otherwise(0.0).alias("coverage"))


def nearest_partition(candidates: DataFrame, by: str, expected: str, distance: float) -> DataFrame:
    """by and the distance of the viable candidate(distance, clusters, ari, viable) with the fewest clusters beyond the expected, then nearest to the default distance, then most stable; the default if none is viable."""
    fits = yes("viable") & (F.col("clusters") >= F.col(expected))
    order = F.struct(F.col("clusters") - F.col(expected), F.abs(F.col("distance") - distance), -num("ari"), F.col("distance"))
    return candidates.groupBy(by).agg(F.coalesce(F.min_by(F.when(fits, F.col("distance")), F.when(fits, order)), F.lit(distance)).alias("chosen"))


def enrollment(turns: DataFrame, by: str, key: str, k: int = 12, least: float = 1.0, most: float = 20.0, local: float = 0.55, remote: float = 0.15) -> DataFrame:
    """by, key, enrol_score of the k turns that show a voice best: role Me, long enough, not under review, two words, mostly local and hardly remote."""
    seconds = num("duration_sec")
    good = (label("role") == "Me") & (seconds >= least) & (seconds <= most) & ~yes("needs_review") & (num("words") >= 2) & (num("local_only") >= local) & (num("remote_active") <= remote)
    score = 100 * num("local_only") - 80 * num("remote_active") + 2 * F.least(F.lit(12.0), seconds) + F.least(F.lit(12.0), num("words"))
    rows = turns.filter(good).select(by, key, F.round(score, 6).alias("enrol_score"))
    best = rows.groupBy(by).agg(F.slice(F.sort_array(F.collect_list(F.struct("enrol_score", (-F.col(key)).alias("k"))), asc=False), 1, k).alias("b"))
    return best.select(by, F.explode("b").alias("x")).select(by, (-F.col("x.k")).alias(key), F.col("x.enrol_score").alias("enrol_score"))


def micro_stability(rows: DataFrame) -> DataFrame:
    """status and reasons of a short selection re-recognised from raw and filtered sound: it needs a plausible speech rate or support from both, and agreement.

    Reads ms, chars, words, baseline (the selected source is the old text), raw_support and filtered_support (likeness to the
    selection of each family's best attempt, null without one) and families (likeness between them, null without both).
    """
    # fixed values: 1.25 s, 24 characters a second, support from 0.72, disagreement under 0.45
    short = num("ms") <= 1250
    raw, filtered = F.coalesce(F.col("raw_support") >= 0.72, F.lit(False)), F.coalesce(F.col("filtered_support") >= 0.72, F.lit(False))
    named = [
        ("implausible_short_island_speech_rate", short & (num("chars") / F.greatest(num("ms"), F.lit(1.0)) * 1000 > 24) & ~(raw & filtered)),
        ("baseline_only_selection_without_canonical_support", short & yes("baseline") & ~raw & ~filtered),
        ("short_island_source_disagreement", short & (num("words") >= 2) & ~(raw & filtered) & F.coalesce(F.col("families") < 0.45, F.lit(False))),
    ]
    out = rows.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named])))
    return out.withColumn("status", F.when(F.size("reasons") > 0, "needs_review").otherwise("stable"))


#: Folds that are trained side by side, rows that are read at once, and groups of partial sums for each block of folds.
FOLDS_TOGETHER, ROWS_TOGETHER, SLOTS = 64, 2000, 16


def _doubles(raw: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(shape)


def _chunks(rows: DataFrame, d: int) -> DataFrame:
    """chunk, slot and the arrays of up to ROWS_TOGETHER rows(_g, _y, _x): fold, class, and features behind a one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_TOGETHER):
                part = batch.slice(i, ROWS_TOGETHER)
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                x = np.concatenate([np.ones((len(x), 1)), x], 1)
                arrays = [part.column(0).to_numpy().astype(np.int64), part.column(1).to_numpy().astype(np.float64), x]
                yield pa.RecordBatch.from_arrays([pa.array([serial], pa.int64()), pa.array([serial % SLOTS], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], names=["chunk", "slot", "g", "y", "x"])
                serial += 1

    return rows.select("_g", "_y", "_x").mapInArrow(run, "chunk long, slot int, g binary, y binary, x binary")


def _partial_sums(chunks: DataFrame, folds: DataFrame, blocks: int, d: int) -> DataFrame:
    """block, h, g: second and first derivatives of the loss of each fold of a block, over all rows but the fold's own."""

    def run(table: pa.Table) -> pa.Table:
        ids = np.frombuffer(table["folds"][0].as_py(), np.int64)
        w, weight = _doubles(table["w"][0].as_py(), -1, d + 1), _doubles(table["weights"][0].as_py(), -1, 2)
        h, g = np.zeros((len(ids), d + 1, d + 1)), np.zeros((len(ids), d + 1))
        for own, y, x in zip(table["g"], table["y"], table["x"], strict=True):
            own, y, x = np.frombuffer(own.as_py(), np.int64), _doubles(y.as_py(), -1), _doubles(x.as_py(), -1, d + 1)
            p = 1 / (1 + np.exp(-np.clip(x @ w.T, -500, 500)))
            use = np.where(y[:, None] == 1, weight[:, 1], weight[:, 0]) * (own[:, None] != ids)
            g += (use * (p - y[:, None])).T @ x
            bend = use * p * (1 - p)
            for k in range(len(ids)):
                h[k] += (x.T * bend[:, k]) @ x
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "h": pa.array([h.tobytes()], pa.binary()), "g": pa.array([g.tobytes()], pa.binary())})

    every = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(folds.select("block", "folds", "w", "weights"), "block")
    return every.groupBy("block", "slot").applyInArrow(run, "block int, h binary, g binary")


def _stepped(folds: DataFrame, sums: DataFrame, d: int) -> DataFrame:
    """folds after a Newton step, with the largest change in `moved`."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        w, ridge = _doubles(row["w"], -1, d + 1), _doubles(row["ridge"], -1, d + 1)
        h = sum(_doubles(x.as_py(), -1, d + 1, d + 1) for x in right["h"]) + np.eye(d + 1) * (ridge[:, None, :] + 1e-12)
        g = sum(_doubles(x.as_py(), -1, d + 1) for x in right["g"]) + ridge * w
        step = np.linalg.solve(h, g[:, :, None])[:, :, 0]
        row |= {"w": (w - step).tobytes(), "moved": float(np.abs(step).max())}
        return pa.table({k: pa.array([v], left.schema.field(k).type) for k, v in row.items()})

    shape = "block int, folds binary, w binary, weights binary, ridge binary, moved double"
    return folds.groupBy("block").cogroup(sums.select(F.col("block").alias("of"), "h", "g").groupBy("of")).applyInArrow(run, shape)


def leave_one_out(rows: DataFrame, group: str, features: str, target: str, l2: float = 1.0, steps: int = 30) -> DataFrame:
    """rows with `predicted` (0 or 1) and `confidence`, each group judged by a model that is trained on the others.

    The model is a logistic regression of standardised features, classes weighted alike, with weights (not the intercept)
    drawn to 0 by l2. All folds take their Newton steps together: each job sums the derivatives of every fold over all rows
    but the fold's own, in blocks of folds, so the number of jobs doesn't grow with that of groups. Where the others have one
    class only, that one is predicted with confidence 1; with fewer than two groups, or a class of fewer than two rows, each row's
    own class is. A null group is a group. Rows need a class and features of one length without nulls.
    """
    d = rows.select(F.max(F.size(features))).first()[0] or 0
    counts = {r["y"]: r["count"] for r in rows.groupBy(F.col(target).cast("int").alias("y")).count().collect()}  # two classes
    per = rows.groupBy(group).agg(F.count("*").alias("_n"), F.sum(F.col(target).cast("double")).alias("_ones"))
    groups = materialize(per.withColumn("_id", F.monotonically_increasing_id()), "groups")
    many = groups.count()
    if many < 2 or min(counts.get(0, 0), counts.get(1, 0)) < 2:
        return rows.withColumn("predicted", F.col(target).cast("int")).withColumn("confidence", F.lit(1.0))
    known = materialize(null_safe(rows.withColumn("_x", F.transform(features, lambda v: v.cast("double"))).withColumn("_y", F.col(target).cast("double")), groups.select(group, F.col("_id").alias("_g")), [group]), "judged")
    each = known.select("_g", F.posexplode("_x").alias("i", "v")).groupBy("_g", "i").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    all_ = each.groupBy("i").agg(F.sum("s").alias("ts"), F.sum("q").alias("tq"))  # a row for each feature
    total = sum(counts.values())
    left = F.lit(float(total)) - F.col("_n")
    spread = each.join(F.broadcast(all_), "i").join(groups.select(F.col("_id").alias("_g"), "_n"), "_g")
    variance = (F.col("tq") - F.col("q")) / left - F.pow((F.col("ts") - F.col("s")) / left, 2)
    ridge = spread.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.greatest(variance, F.lit(0.0)).alias("v")))), lambda x: x["v"]).alias("ridge"))
    ones = F.lit(float(counts[1])) - F.col("_ones")
    trained = groups.join(ridge, groups["_id"] == ridge["_g"]).filter((left > ones) & (ones > 0))
    blocks = max(1, -(-many // FOLDS_TOGETHER))
    trained = trained.select("_id", left.alias("n"), ones.alias("ones"), "ridge", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int").alias("block"))

    def begin(table: pa.Table) -> pa.Table:
        n, one = table["n"].to_numpy(), table["ones"].to_numpy()
        variances = np.array(table["ridge"].to_pylist(), float).reshape(-1, d)
        # a feature without spread counts as it is; its weight is still drawn to 0
        ridge = np.concatenate([np.zeros((len(n), 1)), l2 * np.where(variances > 1e-12, variances, 1.0)], 1)
        arrays = [table["_id"].to_numpy(), np.zeros((len(n), d + 1)), np.stack([n / (2 * (n - one)), n / (2 * one)], 1), ridge]
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), **{k: pa.array([a.tobytes()], pa.binary()) for k, a in zip(("folds", "w", "weights", "ridge"), arrays, strict=True)}, "moved": pa.array([1.0])})

    folds = materialize(trained.groupBy("block").applyInArrow(begin, "block int, folds binary, w binary, weights binary, ridge binary, moved double"), "folds")
    middle = {r["i"]: r["ts"] / total for r in all_.collect()}  # rows are centred alike for all folds, which changes the intercepts only
    centred = known.withColumn("_x", F.transform("_x", lambda v, i: v - F.get(F.array(*[F.lit(float(middle[i])) for i in range(d)]), i)))
    chunks = materialize(_chunks(centred, d), "chunks")
    for _ in range(steps):
        folds = materialize(_stepped(folds, _partial_sums(chunks, folds, blocks, d), d), "folds")
        if (folds.agg(F.max("moved")).first()[0] or 0.0) < 1e-10:
            break

    def each_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, w in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids.as_py(), np.int64)), pa.array(list(_doubles(w.as_py(), -1, d + 1)), pa.list_(pa.float64()))], names=["_g", "_w"])

    models = folds.select("folds", "w").mapInArrow(each_fold, "_g long, _w array<double>")
    told = centred.join(models, "_g", "left").join(groups.select(F.col("_id").alias("_g"), (ones > 0).cast("int").alias("_only")), "_g")
    z = F.get("_w", F.lit(0)) + F.aggregate(F.zip_with("_x", F.slice("_w", 2, d), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    p = 1 / (1 + F.exp(-z))
    out = told.withColumn("predicted", F.when(F.col("_w").isNull(), F.col("_only")).otherwise((p >= 0.5).cast("int")))
    return out.withColumn("confidence", F.when(F.col("_w").isNull(), 1.0).otherwise(F.greatest(p, 1 - p))).select(*rows.columns, "predicted", "confidence")
