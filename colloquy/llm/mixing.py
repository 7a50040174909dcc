"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

Weights are source token shares raised to an exponent and normalised. The exponent is the largest that meets a target
entropy or a limit on repetition, found by narrowing an interval, a grid of exponents at a time; each narrowing is one
aggregate over the table of sources. Documents fall into hashed blocks of about equal token counts. Every epoch of a source
deals all its blocks in an order of its own; the last epoch ends at the document where the source's budget is spent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.textarrays import blocks
from colloquy.storage import materialize

BLOCK_TOKENS = 1 << 16
#: Blocks grow with the corpus beyond this number, so that their order stays a small table.
MOST_BLOCKS = 1 << 20


def with_token_counts(docs: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """Columns keep of docs and the number of words of text; a null text has none."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.diff(b.words()[2]) for b in blocks(batch.column(at))]
            column = pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], column], names=[*keep, name])

    return docs.mapInArrow(run, T.StructType([*[docs.schema[c] for c in keep], T.StructField(name, T.LongType())]))


def entropy(sources: DataFrame, exponents: list[float]) -> DataFrame:
    """exponent, value: entropy in nats of the weights of sources(share) at each exponent."""
    each = sources.withColumn("exponent", F.explode(F.array(*map(F.lit, exponents)))).withColumn("x", F.pow("share", "exponent"))
    sums = each.groupBy("exponent").agg(F.sum("x").alias("z"), F.sum(F.col("x") * F.ln("x")).alias("l"))
    return sums.select("exponent", (F.ln("z") - F.col("l") / F.col("z")).alias("value"))


def find_exponent(sources: DataFrame, target_entropy: float | None, repetition: float | None, grid: int = 16, rounds: int = 10) -> float:
    """The largest exponent in [0, 1] with an entropy of at least the target, or the smallest whose repetition keeps the limit.

    Repetition is how much more often the smallest source is seen than the largest, (largest share / smallest) ** (1 - exponent).
    An entropy that even equal weights miss gives 0, a limit of 1 or less gives 1.
    """
    low, high = 0.0, 1.0
    if target_entropy is None:
        r = sources.agg(F.max("share").alias("a"), F.min("share").alias("b")).first()
        if r["a"] is None or r["a"] == r["b"]:
            return 1.0
        for _ in range(50):
            middle = (low + high) / 2
            low, high = (low, middle) if (r["a"] / r["b"]) ** (1 - middle) <= repetition else (middle, high)
        return high
    for _ in range(rounds):
        points = [low + (high - low) * i / grid for i in range(grid + 1)]
        values = entropy(sources, points).orderBy("exponent").collect()
        fine = [i for i, r in enumerate(values) if r["value"] is not None and r["value"] >= target_entropy - 1e-12]
        if not fine:
            return 0.0
        i = max(fine)
        if i == grid:
            return high
        low, high = points[i], points[i + 1]
    return low


def source_weights(counted: DataFrame, target_entropy: float | None = None, repetition: float | None = None, budget: int | None = None) -> DataFrame:
    """source, tokens, weight, quota for counted(source, n_tokens). A null source is a source of its own, one without tokens has no weight.

    target_entropy: a share of the highest, ln(number of sources). budget: tokens in all; if None, as many as let the
    source that is seen least be seen whole.
    """
    sums = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    sources = materialize(sums, "sources")
    some = sources.filter("tokens > 0")
    total = some.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    shares = some.withColumn("share", F.col("tokens") / F.lit(float(total["t"] or 1)))
    exponent = find_exponent(shares, None if target_entropy is None else target_entropy * float(np.log(max(total["n"], 1))), repetition)
    powers = shares.withColumn("x", F.pow("share", F.lit(exponent)))
    r = powers.agg(F.sum("x").alias("z"), F.max(F.col("tokens") / F.col("x")).alias("whole")).first()
    z = r["z"] or 1.0
    spend = float(budget) if budget is not None else (r["whole"] or 0.0) * z
    weight = F.pow(F.col("tokens") / F.lit(float(total["t"] or 1)), F.lit(exponent)) / z
    weight = F.when(F.col("tokens") > 0, weight).otherwise(0.0)
    return sources.select("source", "tokens", weight.alias("weight"), F.greatest(F.floor(weight * spend + 1e-6), F.lit(0)).cast("long").alias("quota"))


def _unit(*columns: Column | str) -> Column:
    """A hash as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / float(1 << 53)


def mix(docs: DataFrame, target_entropy: float | None = None, repetition: float | None = None, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 1, keep_all: bool = False) -> DataFrame:
    """The rows of docs(doc_id, source, n_tokens, ...), each once for every epoch in which it is dealt, with epoch and place.

    place, in [0, 1), orders the whole mixture: at each point the sources have spent equal parts of their budgets. keep_all:
    documents of sources without tokens are dealt once, as is every document in epoch 0. Reads docs twice; repeated rows
    count one by one. A null source is a source of its own; rows with null or equal doc_ids are dealt apart where any of
    their columns differs. Columns that are called epoch or place are replaced, others may have any name. An empty table
    gives no rows.
    """
    sources = materialize(source_weights(docs.select("source", "n_tokens"), target_entropy, repetition, budget), "weights")
    size = max(block_tokens, (sources.agg(F.sum("tokens")).first()[0] or 0) // MOST_BLOCKS)
    sized = sources.withColumn("blocks", F.greatest(F.ceil(F.col("tokens") / size), F.lit(1))).select(F.col("source").alias("of_source"), "tokens", "quota", "blocks")
    kept = [c for c in docs.columns if c not in ("epoch", "place")]
    hashed = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = docs.select("source", "n_tokens", F.xxhash64(*hashed).alias("key"), F.struct(*kept).alias("row"))
    blocked = rows.join(sized, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source").withColumn("block", F.floor(_unit("key", F.lit(seed)) * F.col("blocks")))
    table = blocked.groupBy("source", "block", "tokens", "quota").agg(F.sum("n_tokens").alias("size"))
    last = F.when(F.col("tokens") > 0, F.ceil(F.col("quota") / F.col("tokens")) - 1).otherwise(F.lit(0 if keep_all else -1))
    last = F.greatest(last, F.lit(0)) if keep_all else last
    dealt = table.withColumn("last", last.cast("int")).filter("last >= 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("last"))))
    before = Window.partitionBy("source", "epoch").orderBy(F.xxhash64("block", "epoch", F.lit(seed + 1)), "block").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("start", F.col("tokens") * F.col("epoch") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    whole = F.col("start") + F.col("size") <= F.col("quota")
    if keep_all:
        whole = whole | (F.col("epoch") == 0)
    dealt = dealt.filter((F.col("start") < F.col("quota")) | whole).select(F.col("source").alias("of_source"), F.col("block").alias("of_block"), "epoch", "start", "size", whole.alias("whole"))
    dealt = materialize(dealt, "blocks")
    met = blocked.join(dealt, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("block") == F.col("of_block")))
    inside = _unit("key", "epoch", F.lit(seed + 2))
    place = F.least((F.col("start") + inside * F.col("size")) / F.greatest("quota", F.lit(1)), F.lit(1 - 1e-12))
    out = met.filter("whole").select("row", "epoch", place.alias("place"))
    spent = Window.partitionBy("of_source", "of_block", "epoch").orderBy(inside, "key").rowsBetween(Window.unboundedPreceding, 0)
    edge = met.filter("not whole").withColumn("spent", F.sum("n_tokens").over(spent)).filter(F.col("start") + F.col("spent") <= F.col("quota"))
    return out.unionAll(edge.select("row", "epoch", place.alias("place"))).select("row.*", "epoch", "place")


def mix_documents(docs: DataFrame, target_entropy: float = 0.97) -> DataFrame:
    """doc_id, source, n_tokens, epoch, place of a mixture with as many tokens as docs(doc_id, source, text) and at least this share of the highest entropy.

    A null text has no tokens, and a null source is a source; sources without tokens aren't dealt. Null ids, repeated rows
    and an empty table are as in mix; other columns are ignored.
    """
    counted = materialize(with_token_counts(docs.select("doc_id", "source", "text"), "n_tokens", ["doc_id", "source"]), "counted")
    total = counted.agg(F.sum("n_tokens")).first()[0] or 0
    return mix(counted, target_entropy=target_entropy, budget=total)


def repeat_small_sources(docs: DataFrame, repetition: float) -> DataFrame:
    """All rows of docs, with their columns, those of smaller sources up to `repetition` times as often, no document left out."""
    clash = {c: f"_own_{c}" for c in ("n_tokens", "epoch", "place") if c in docs.columns}
    renamed = docs.withColumnsRenamed(clash)
    counted = with_token_counts(renamed, "n_tokens", renamed.columns)
    mixed = mix(counted, repetition=repetition, keep_all=True).drop("n_tokens", "epoch", "place")
    return mixed.withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns)
