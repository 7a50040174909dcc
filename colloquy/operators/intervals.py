"""Interval algebra over rows with start and end: joins by time buckets, islands, differences, windows.

Bounds are numbers of one unit, mostly milliseconds. Two conventions hold: intervals that touch merge, but don't overlap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.joins import null_safe

#: Width of the buckets of time that windows run in, in the unit of the bounds: an hour of milliseconds.
WIDTH = 3_600_000


def overlap(a_start, a_end, b_start, b_end) -> Column:
    """Length that two intervals share, 0 if none."""
    return F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], width: int, how: str = "inner") -> DataFrame:
    """Pairs of equal keys whose intervals overlap, as structs l and r. how: inner, left, left_semi or left_anti.

    Both sides are cut into buckets of `width`, so the join is an equality join on keys and bucket; a pair counts in the
    first bucket that its overlap touches. Choose a width of about the usual interval length. Neither side is broadcast: in
    buckets a table is many times what its files say.
    """

    def bucketed(side: DataFrame, name: str) -> DataFrame:
        last = F.greatest(F.floor((F.col("end") - 1) / width), F.floor(F.col("start") / width))
        return side.select(*on, F.struct(*side.columns).alias(name), F.explode(F.sequence(F.floor(F.col("start") / width), last)).alias("_bucket"))

    lb, rb = bucketed(left, "l"), bucketed(right, "r")
    meet = (F.col("l.start") < F.col("r.end")) & (F.col("l.end") > F.col("r.start"))
    first = F.col("_bucket") == F.floor(F.greatest("l.start", "r.start") / width)
    pairs = lb.join(rb.hint("merge"), [*on, "_bucket"]).filter(meet & first).drop("_bucket")
    if how == "inner":
        return pairs
    hit = pairs.select(*on, "l").distinct()
    base = left.select(*on, F.struct(*left.columns).alias("l"))
    if how == "left":
        alone = base.join(hit, [*on, "l"], "left_anti")
        return pairs.unionByName(alone.withColumn("r", F.lit(None).cast(pairs.schema["r"].dataType)))
    return base.join(hit, [*on, "l"], how).select("l.*")


def with_carry(rows: DataFrame, by: list[str], before: dict[str, tuple[Column, Callable]] | None = None, after: dict[str, tuple[Column, Callable]] | None = None) -> DataFrame:
    """rows(by, _k, ...) with what the other buckets of the key give: name: (aggregate of a bucket, how those of all earlier, or later, buckets combine).

    Windows then run inside a bucket `_k`, so no task sorts all rows of a key; only the short table of buckets is ordered by key.
    Null keys are a key like any other, and a null bucket (a row without a time) one before all others.
    """
    named = [(n, a, f, True) for n, (a, f) in (before or {}).items()] + [(n, a, f, False) for n, (a, f) in (after or {}).items()]
    per = rows.groupBy(*by, "_k").agg(*[a.alias(n) for n, a, _, _ in named])
    w = Window.partitionBy(*by).orderBy("_k")
    sides = {True: w.rowsBetween(Window.unboundedPreceding, -1), False: w.rowsBetween(1, Window.unboundedFollowing)}
    return null_safe(rows, per.select(*by, "_k", *[f(n).over(sides[earlier]).alias(n) for n, _, f, earlier in named]), [*by, "_k"])


def bucketed(rows: DataFrame, at: str = "start", width: int = WIDTH) -> DataFrame:
    return rows.withColumn("_k", F.floor(F.col(at) / width))


def lagged(rows: DataFrame, by: list[str], order: list[str], previous: dict[str, str] | None = None, following: dict[str, str] | None = None, width: int = WIDTH) -> DataFrame:
    """Adds column values of the previous and the following row as {new name: column}, in the order of order[0] (a time) and then the rest; null at an end."""
    previous, following = previous or {}, following or {}
    rest = list(dict.fromkeys([*previous.values(), *following.values()]))
    row = F.struct(*order, *[F.col(c).alias(f"_v{i}") for i, c in enumerate(rest)])
    place = {c: i for i, c in enumerate(rest)}
    out = with_carry(bucketed(rows, order[0], width), by, {"_b": (F.max(row), F.last)} if previous else {}, {"_a": (F.min(row), F.first)} if following else {})
    w = Window.partitionBy(*by, "_k").orderBy(*order)
    edge = F.row_number().over(w)
    for name, column in previous.items():
        out = out.withColumn(name, F.when(edge == 1, F.col(f"_b._v{place[column]}")).otherwise(F.lag(column).over(w)))
    last = F.row_number().over(Window.partitionBy(*by, "_k").orderBy(*[F.desc(c) for c in order]))
    for name, column in following.items():
        out = out.withColumn(name, F.when(last == 1, F.col(f"_a._v{place[column]}")).otherwise(F.lead(column).over(w)))
    return out.drop("_k", "_b", "_a")


def numbered(rows: DataFrame, by: list[str], order: list[str], new: str, name: str) -> DataFrame:
    """rows(_k, ...) with the running sum of the 0 or 1 in column new."""
    out = with_carry(rows, by, {"_sum": (F.sum(new), F.sum)})
    w = Window.partitionBy(*by, "_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn(name, F.coalesce("_sum", F.lit(0)) + F.sum(new).over(w)).drop("_sum", new)


def islands(rows: DataFrame, by: list[str], gap: int = 0, strict: bool = False, order: tuple[str, ...] = (), width: int = WIDTH) -> DataFrame:
    """Adds `island`, from 0: a row starts one if it begins more than gap (strict: at least gap) after the running end of those before."""
    out = with_carry(bucketed(rows, width=width), by, {"_reach": (F.max("end"), F.max)})
    w = Window.partitionBy(*by, "_k").orderBy("start", "end", *order)
    reach = F.greatest(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_reach"))
    new = F.col("start") >= reach + gap if strict else F.col("start") > reach + gap
    out = out.withColumn("_new", F.when(new, 1).otherwise(0)).drop("_reach")
    return numbered(out, by, ["start", "end", *order], "_new", "island").drop("_k")


def merge(rows: DataFrame, by: list[str], gap: int = 0) -> DataFrame:
    """by, island, start, end, n: rows merged where they touch or are at most gap apart."""
    return islands(rows, by, gap).groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


def union_length(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, union_length: how much the intervals cover together."""
    return merge(rows, by).groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).alias("union_length"))


def clip(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """The parts of intervals inside [start, end]."""
    return rows.withColumn("start", F.greatest("start", start)).withColumn("end", F.least("end", end)).filter("start < end")


def _sweep(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Elementary segments with the numbers of a and b intervals that cover them."""

    def edges(side: DataFrame, name: str) -> DataFrame:
        other = "b" if name == "a" else "a"
        pairs = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))
        return side.select(*by, F.explode(pairs).alias("e")).select(*by, F.col("e.at").alias("at"), F.col("e.d").alias(f"d{name}"), F.lit(0).alias(f"d{other}"))

    both = edges(a, "a").unionByName(edges(b, "b")).groupBy(*by, "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    both = with_carry(bucketed(both, "at"), by, {"_a": (F.sum("da"), F.sum), "_b": (F.sum("db"), F.sum)}, {"_next": (F.min("at"), F.first)})
    w = Window.partitionBy(*by, "_k").orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    covered = [(F.coalesce(f"_{c}", F.lit(0)) + F.sum(f"d{c}").over(run)).alias(c) for c in "ab"]
    return both.select(*by, F.col("at").alias("start"), F.coalesce(F.lead("at").over(w), F.col("_next")).alias("end"), *covered).filter("end is not null")


def difference(a: DataFrame, b: DataFrame, by: list[str], least: int = 0) -> DataFrame:
    """by, start, end: what a covers and b doesn't, pieces that touch merged, those shorter than least left out."""
    pieces = _sweep(a.select(*by, "start", "end"), b.select(*by, "start", "end"), by).filter("a > 0 and b = 0")
    return merge(pieces, by).filter(F.col("end") - F.col("start") >= least).select(*by, "start", "end")


def intersection_and_union(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """by, both, either: lengths of the intersection and the union of what a and b cover."""
    size = F.col("end") - F.col("start")
    parts = _sweep(a.select(*by, "start", "end"), b.select(*by, "start", "end"), by)
    return parts.groupBy(*by).agg(F.sum(F.when((F.col("a") > 0) & (F.col("b") > 0), size).otherwise(0)).alias("both"), F.sum(F.when((F.col("a") > 0) | (F.col("b") > 0), size).otherwise(0)).alias("either"))


def complement(rows: DataFrame, by: list[str], frame: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Free parts of frame(by, start, end) outside of rows, each widened by guards before and after."""
    guarded = rows.select(*by, (F.col("start") - before).alias("start"), (F.col("end") + after).alias("end"))
    return difference(frame, guarded, by)


def runs(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """by, run, value, n, first, last: consecutive rows with an equal value (null equals null); order[0] gives first and last."""
    marked = lagged(rows.withColumn("_one", F.lit(1)), by, order, {"_before": value, "_some": "_one"})
    marked = marked.withColumn("_new", F.when(F.col(value).eqNullSafe(F.col("_before")) & F.col("_some").isNotNull(), 0).otherwise(1))
    marked = numbered(bucketed(marked, order[0]), by, order, "_new", "run")
    return marked.groupBy(*by, "run").agg(F.first(value).alias(value), F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def tumbling(frame: DataFrame, by: list[str], size: int, pad: int) -> DataFrame:
    """Hard windows of `size` over frame(by, start, end), numbered from 0, with bounds padded for decoding and clipped to the frame."""
    n = F.ceil((F.col("end") - F.col("start")) / size).cast("int")
    at = frame.filter("end > start").select(*by, "start", "end", F.explode(F.sequence(F.lit(0), n - 1)).alias("index"))
    hard = F.col("start") + F.col("index") * size
    hard_end = F.least(hard + size, F.col("end"))
    return at.select(*by, "index", hard.alias("hard_start"), hard_end.alias("hard_end"), F.greatest(hard - pad, F.col("start")).alias("clip_start"), F.least(hard_end + pad, F.col("end")).alias("clip_end"))


def sliding(rows: DataFrame, keep: list[str], size: int, stride: int, least_tail: int) -> DataFrame:
    """Windows of `size` every `stride` inside each row's interval; a remainder of at least least_tail gets a last window that ends with the row."""
    length = F.col("end") - F.col("start")
    full = F.when(length >= size, F.floor((length - size) / stride) + 1).otherwise(0)
    starts = F.when(full > 0, F.transform(F.sequence(F.lit(0), (full - 1).cast("int")), lambda i: F.col("start") + i * stride)).otherwise(F.expr("cast(array() as array<bigint>)"))
    rest = F.when(full > 0, length - ((full - 1) * stride + size)).otherwise(length)
    tail = F.when(rest >= least_tail, F.array(F.greatest(F.col("end") - size, F.col("start")))).otherwise(F.expr("cast(array() as array<bigint>)"))
    out = rows.select(*keep, F.col("end").alias("_end"), F.posexplode(F.concat(starts, tail)).alias("index", "start"))
    return out.select(*keep, "index", "start", F.least(F.col("start") + size, F.col("_end")).alias("end"))


def nearest(left: DataFrame, right: DataFrame, by: list[str], at: str, tie: str, width: int = WIDTH) -> DataFrame:
    """left with the nearest row of right by column `at` as struct `near` (ties: earlier, then smaller `tie`); null if there is none.

    One sort of both sides by key and time bucket, instead of comparing all pairs; a bucket knows the last row of right
    before it and the first one after it.
    """
    first = right.groupBy(*by, at).agg(F.min(F.struct(F.col(tie).alias("t"), F.struct(*right.columns).alias("r"))).alias("x")).select(*by, at, "x.r")
    l = left.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(first.schema["r"].dataType).alias("_r"))
    r = first.select(*by, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), F.col("r").alias("_r"))
    own = F.when(F.col("_side") == 0, F.col("_at"))
    both = with_carry(bucketed(l.unionByName(r), "_at", width), by, {"_lo": (F.max_by("_r", own), lambda n: F.last(n, ignorenulls=True))}, {"_hi": (F.min_by("_r", own), lambda n: F.first(n, ignorenulls=True))})
    w = Window.partitionBy(*by, "_k")
    back = w.orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.orderBy(F.desc("_at"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    before, after = F.coalesce(F.last("_r", ignorenulls=True).over(back), F.col("_lo")), F.coalesce(F.last("_r", ignorenulls=True).over(ahead), F.col("_hi"))
    both = both.withColumn("_b", before).withColumn("_a", after).filter("_side = 1")
    closer = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull(), F.col("_b")).when(F.col("_at") - F.col(f"_b.{at}") <= F.col(f"_a.{at}") - F.col("_at"), F.col("_b")).otherwise(F.col("_a"))
    return both.select("_l.*", closer.alias("near"))
