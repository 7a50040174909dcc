"""N-gram Jaccard join: links texts whose sets of word shingles have a Jaccard similarity of at least a threshold.

Texts with equal sets are one node. Nodes are joined into classes, in two steps; in both, bit counts of hashed bitmaps bound
an overlap from above before sorted arrays are intersected exactly.

1. Stars. Nodes that share a minimum hash are compared with one of them, drawn anew for each hash. A second wave takes more
   hashes, and of two classes that are still apart only the pair whose bit counts are nearest. This joins most of every
   large group by a number of comparisons in proportion to its size.
2. Tiles. Sets in one order of shingles, frequent ones last, can only reach the threshold if they share a shingle in a
   prefix of length n - ceil(threshold * n) + 1. Of shingles that nodes of different classes share, tiles compare the
   bitmaps of neighbouring size bands. A tile doesn't send on pairs, but its nodes that may link with another class, once
   each, and the cluster that such links would make.
3. Clusters. The arrays of these nodes are shipped once, to their cluster, in tiles of size bands again. There bit counts
   and then exact intersections join classes; a tile sends on the links of a tree at most. Pairs inside a class can't
   change it and are left out.

Hot shingles and large clusters are cut into blocks that meet pairwise, so no task holds a whole large group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.graph import components
from colloquy.llm.textarrays import Block, mix, parts, release_memory, shingle_hashes
from colloquy.storage import bound_batches, discard, materialize

#: Shingles are compared by 48 bits of their hash: two differ with the same bits once in 2**48.
BITS = np.uint64(16)
#: Minimum hashes of each wave of stars.
WAVES = (2, 6)
#: The most frequent shingles that are ordered last; more would only save comparisons.
FREQUENT = 131_072
#: Documents of a batch that must share a shingle before the batch counts it, and the count from which it is frequent.
SHARED, FREQUENT_FROM = 2, 16
#: Prefix shingles, and rows of tiles, that meet in one task.
TOGETHER, TILE_ROWS = 500_000, 30_000
#: Nodes with one shingle that are one tile, and shingles of a cluster whose arrays are.
BLOCK, ARRAYS_TOGETHER = 4096, 2_000_000
#: Above so many nodes a tile goes node by node over those outside its largest class.
SMALL_TILE = 48
#: Arrays' shingles that meet in one task.
CLUSTER_TASK = 1_500_000
MASK_SLOTS = 1 << 24
#: Shingles whose documents are counted at once.
COUNTED_TOGETHER = 1_000_000
SETS = "doc_id long, n int, sig long, mins array<long>, bits binary, shingles binary, shared array<long>, times array<int>"
_SETS = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
#: Bits of the smallest and the largest bitmap; between them, a set has at least a bit for each shingle.
BITMAP, BITMAP_MOST = 1024, 1 << 15


def _pack(x: np.ndarray) -> bytes:
    return x.astype("<u8").view("<u2").reshape(-1, 4)[:, :3].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 4), "<u2")
    out[:, :3] = np.frombuffer(raw, "<u2").reshape(-1, 3)
    return out.view("<u8").ravel().astype(np.uint64)


def bitmap_size(n: np.ndarray) -> np.ndarray:
    """Bits of the bitmap of a set of n shingles, a power of two."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), BITMAP, BITMAP_MOST)


def bitmaps(shingles: np.ndarray, row: np.ndarray, size: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bitmaps of size[row] bits with a bit for each shingle by its hash, one after the other, and their bounds in bytes."""
    bounds = np.concatenate([[0], np.cumsum(size)])
    bits = np.zeros(bounds[-1], bool)
    bits[bounds[row] + (shingles >> np.uint64(20)).astype(np.int64) % size[row]] = True
    return np.packbits(bits, bitorder="little").tobytes(), bounds // 8


class Bitmaps:
    """Bitmaps of several sizes. Two are compared at the size of the smaller one, to which the other one is folded."""

    def __init__(self, raw: list[bytes]):
        self.size = np.array([len(x) for x in raw], np.int64)
        self.place, self.rows = {}, {}
        for size in np.unique(self.size):
            parts, place, done = [], np.full(len(raw), -1), 0
            for larger in (size, 2 * size):
                own = np.flatnonzero(self.size == larger)
                if len(own):
                    x = np.frombuffer(b"".join(raw[i] for i in own), "<u8").reshape(len(own), -1)
                    parts.append(x if larger == size else x[:, : size // 8] | x[:, size // 8 :])
                    place[own] = done + np.arange(len(own))
                    done += len(own)
            self.place[size], self.rows[size] = place, np.concatenate(parts)

    def differing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many bits of rows i and j differ; 0, which bounds nothing, where one is more than twice as large."""
        out, level = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        for size in np.unique(level):
            place, rows = self.place[size], self.rows[size]
            at = np.flatnonzero((level == size) & (place[i] >= 0) & (place[j] >= 0))
            for k in range(0, len(at), 50_000):
                some = at[k : k + 50_000]
                out[some] = np.bitwise_count(rows[place[i[some]]] ^ rows[place[j[some]]]).sum(1)
        return out


def most_shared(n_x: np.ndarray, n_y: np.ndarray, differing: np.ndarray) -> np.ndarray:
    """An upper bound of the overlap: every bit that differs stands for a shingle that only one set has."""
    return np.minimum((n_x + n_y - differing) // 2, np.minimum(n_x, n_y))


def _reaches(overlap, n_a, n_b, percent: int):
    return 100 * overlap >= percent * (n_a + n_b - overlap)


def _bounds(rows: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(rows, np.arange(n + 1))


def _binary(data: bytes, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype("<i4").tobytes()), pa.py_buffer(data)])


def _block_sets(block: Block, width: int) -> tuple[list[pa.Array], np.ndarray]:
    """Columns n, sig, mins, bits and shingles of a block's texts, and the shingles of all."""
    starts, ends, cuts = block.words()
    hashes, bounds = shingle_hashes(block.word_hashes(starts, ends), cuts, width)
    text = np.repeat(np.arange(block.n), np.diff(bounds))
    order = np.lexsort((hashes, text))
    full, row = hashes[order], text[order]
    new = np.ones(len(full), bool)
    new[1:] = (full[1:] != full[:-1]) | (row[1:] != row[:-1])
    full, row = full[new], row[new]
    at = _bounds(row, block.n)
    n = np.diff(at)
    some = np.flatnonzero(n)
    sig = np.zeros(block.n, np.uint64)
    own = full >> BITS
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
    own, of = own[new], row[new]
    at48 = _bounds(of, block.n)
    mins = np.zeros((block.n, sum(WAVES)), np.uint64)
    if len(some):
        sig[some] = mix(np.bitwise_xor.reduceat(full, at[some]) + np.add.reduceat(full, at[some]) * np.uint64(3) + n[some].astype(np.uint64))
        for k, salt in enumerate(mix(np.arange(1, sum(WAVES) + 1, dtype=np.uint64)) | np.uint64(1)):
            mins[some, k] = np.minimum.reduceat(mix(own * salt), at48[some])
    flat = pa.ListArray.from_arrays(pa.array(np.arange(block.n + 1) * sum(WAVES), pa.int32()), pa.array(mins.view(np.int64).ravel()))
    bits = bitmaps(own, of, bitmap_size(np.diff(at48)))
    columns = [pa.array(n, pa.int32()), pa.array(sig.view(np.int64)), flat, _binary(*bits), _binary(_pack(own), at48 * 6)]
    return columns, own


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """A row of SETS for each of docs(doc_id, text), and rows without sig that count the shingles a batch's documents share."""
    names = [x.split()[0] for x in SETS.split(", ")]

    def counted(every: list[np.ndarray]) -> pa.RecordBatch:
        shared, times = np.unique(np.concatenate(every), return_counts=True)
        frequent = times >= SHARED
        last = [pa.array([shared[frequent].astype(np.int64)], _SETS[6]), pa.array([times[frequent].astype(np.int32)], _SETS[7])]
        return pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in _SETS[:6]], *last], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, size = [], 0
        for batch in batches:
            for part, block in parts(batch, 1):
                columns, own = _block_sets(block, width)
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, *[pa.nulls(block.n, t) for t in _SETS[6:]]], names=names)
                every.append(own)
                size += len(own)
                if size > COUNTED_TOGETHER:
                    yield counted(every)
                    every, size = [], 0
        if size:
            yield counted(every)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SETS)


def frequent_shingles(sets: DataFrame) -> np.ndarray:
    """At most FREQUENT shingles that many documents share, rarer ones first. They only settle the order of prefixes."""
    shared = sets.filter("shared is not null").select(F.explode(F.arrays_zip("shared", "times")).alias("x"))
    counts = shared.groupBy(F.col("x.shared").alias("shingle")).agg(F.sum("x.times").alias("n")).filter(F.col("n") >= FREQUENT_FROM)
    top = counts.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    return top.column("shingle").to_numpy()[::-1].astype(np.uint64)


def _prefixes(batch: pa.RecordBatch, percent: int, ordered: np.ndarray, by_value: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """sig, n, rare and then frequent prefix shingles of each different set of a batch(sig, n, shingles). ordered: the frequent shingles, by_value: their order by value."""
    values, seen = ordered[by_value], set()
    for sig, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        if not n or sig in seen:
            continue
        seen.add(sig)
        own = _unpack(raw)
        length = len(own) + (percent * len(own)) // -100 + 1
        if len(values):
            at = np.minimum(np.searchsorted(values, own), len(values) - 1)
            frequent = values[at] == own
            rare = own[~frequent][:length]
            last = np.sort(by_value[at[frequent]])[: length - len(rare)] if len(rare) < length else by_value[:0]
            yield sig, n, rare, ordered[last]
        else:
            yield sig, n, own[:length], own[:0]


def with_partner(shingle: np.ndarray, n: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """Which rows, sorted by shingle and n, have another one of their shingle that sizes and places allow to link with; of hot shingles all rows stay."""
    cuts = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1], [True]]))
    size = np.repeat(np.diff(cuts), np.diff(cuts))
    most, keep = n - rank * n // 256, size > SMALL_TILE
    i, step = np.flatnonzero(~keep), 1
    while len(i):
        i = i[i + step < len(n)]
        j = i + step
        within = (shingle[i] == shingle[j]) & (percent * n[j] <= 100 * n[i])
        i, j = i[within], j[within]
        fits = (100 + percent) * np.minimum(most[i], most[j]) >= percent * (n[i] + n[j])
        keep[i[fits]] = keep[j[fits]] = True
        step += 1
    return keep


def prefix_rows(sets: DataFrame, percent: int, total: int) -> DataFrame:
    """shingle, sig, n, rank: the prefixes of all different sets, without rare shingles that no second set has in its prefix.

    rank is the shingle's place in the order of its set, as a part of n in steps of 1 / 256, rounded down.
    """
    ordered = frequent_shingles(sets)
    by_value = np.argsort(ordered)
    ranges = max(64, total * (100 - percent) // 100 // TOGETHER)
    rows = sets.filter("sig is not null").select("sig", "n", "shingles")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                found = [x for x in _prefixes(batch.slice(at, 5000), percent, ordered, by_value) if len(x[2])]
                if not found:
                    continue
                sigs, sizes = np.array([x[0] for x in found], "<i8"), np.array([x[1] for x in found], "<u4")
                shingles = np.concatenate([x[2] for x in found])
                owner = np.repeat(np.arange(len(found)), [len(x[2]) for x in found])
                rank = np.concatenate([np.arange(len(x[2])) * 256 // x[1] for x in found]).astype(np.uint8)
                part = ((shingles >> np.uint64(16)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                part, shingles, owner, rank = part[order], shingles[order], owner[order], rank[order]
                cuts = np.searchsorted(part, np.arange(ranges + 1))
                out = []
                for r in range(ranges):
                    s = slice(cuts[r], cuts[r + 1])
                    if s.start < s.stop:
                        who, place = np.unique(owner[s], return_inverse=True)
                        out.append((r, _pack(shingles[s]), place.astype("<u2").tobytes(), sigs[who].tobytes(), sizes[who].tobytes(), rank[s].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *[pa.array([x[i] for x in out], pa.binary()) for i in range(1, 6)]], names=["part", "shingles", "owner", "sigs", "sizes", "ranks"])

    def meet(table: pa.Table) -> pa.Table:
        shingles, sigs, sizes, ranks = [], [], [], []
        for i in range(table.num_rows):
            owner = np.frombuffer(table["owner"][i].as_py(), "<u2")
            shingles.append(_unpack(table["shingles"][i].as_py()))
            sigs.append(np.frombuffer(table["sigs"][i].as_py(), "<i8")[owner])
            sizes.append(np.frombuffer(table["sizes"][i].as_py(), "<u4")[owner])
            ranks.append(np.frombuffer(table["ranks"][i].as_py(), np.uint8))
        s, g, n, r = np.concatenate(shingles), np.concatenate(sigs), np.concatenate(sizes), np.concatenate(ranks)
        order = np.lexsort((g, n, s))
        s, g, n, r = s[order], g[order], n[order], r[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (g[1:] != g[:-1])
        s, g, n, r = s[new], g[new], n[new], r[new]
        keep = with_partner(s, n.astype(np.int64), r.astype(np.int64), percent)
        release_memory()
        return pa.table({"shingle": pa.array(s[keep].astype(np.int64)), "sig": pa.array(g[keep]), "n": pa.array(n[keep].astype(np.int32)), "rank": pa.array(r[keep].astype(np.int32))})

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for x in _prefixes(batch, percent, ordered, by_value) if len(x[3])]
            ranks = [((np.arange(len(x[3])) + len(x[2])) * 256 // x[1]).astype(np.int32) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([x[3].astype(np.int64) for x in found], pa.list_(pa.int64())), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int32()), pa.array(ranks, pa.list_(pa.int32()))], names=["shingles", "sig", "n", "ranks"])

    rare = rows.mapInArrow(deal, "part int, shingles binary, owner binary, sigs binary, sizes binary, ranks binary").groupBy("part").applyInArrow(meet, "shingle long, sig long, n int, rank int")
    if not len(ordered):
        return rare
    frequent = rows.mapInArrow(often, "shingles array<long>, sig long, n int, ranks array<int>").select(F.explode(F.arrays_zip("shingles", "ranks")).alias("x"), "sig", "n")
    frequent = frequent.select(F.col("x.shingles").alias("shingle"), "sig", "n", F.col("x.ranks").alias("rank")).distinct()
    return rare.unionAll(frequent)


def _of_nodes(sets: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """One row of sets with these columns for each sig of nodes(sig).

    A mask of hashed sigs, whose size is bounded, leaves out most other rows before they are shuffled, and a batch passes
    on equal sets once.
    """
    spark = sets.sparkSession
    nodes = materialize(nodes.distinct(), "nodes")
    slots = min(MASK_SLOTS, 1 << max(10, (16 * nodes.count()).bit_length()))
    words = nodes.select(F.pmod("sig", F.lit(slots)).alias("s")).groupBy(F.expr("s div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("b")).toArrow()
    mask = np.zeros(slots // 64, np.int64)
    mask[words["w"].to_numpy()] = words["b"].to_numpy()
    held = spark.sparkContext.broadcast(np.unpackbits(mask.view(np.uint8), bitorder="little").astype(bool))
    picked = sets.filter("sig is not null and n > 0").select("sig", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = batch.column(0).to_numpy()
            first = np.zeros(len(sigs), bool)
            first[np.unique(sigs, return_index=True)[1]] = True
            yield batch.filter(pa.array(first & held.value[sigs % slots]))

    return picked.mapInArrow(run, picked.schema).dropDuplicates(["sig"]).join(nodes, "sig", "left_semi")


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows(sig, ...) with the class of each sig, which is its own where labels(node, component) has none."""
    if labels is None:
        return rows.withColumn("component", F.col("sig"))
    return rows.join(labels.select(F.col("node").alias("sig"), "component"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))


def star_pairs(sets: DataFrame, labels: DataFrame | None, first: int, last: int) -> DataFrame:
    """a, b and their classes of_a, of_b: of nodes that share one of the minimum hashes first to last, each (b) with one drawn by hash (a), unless their classes are the same."""
    keys = sets.filter("n > 0").select("sig", F.explode(F.slice("mins", first + 1, last - first)).alias("key")).distinct()
    keys = _labelled(keys, labels)
    drawn = F.min(F.struct(F.xxhash64("sig", "key").alias("h"), F.col("sig").alias("a"), F.col("component").alias("of_a"))).alias("x")
    heads = keys.groupBy("key").agg(drawn, F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key", "x.a", "x.of_a")
    return keys.join(heads, "key").filter("component <> of_a").select("a", F.col("sig").alias("b"), "of_a", F.col("component").alias("of_b")).distinct()


def verify(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs(a, b) of sigs whose sets reach the threshold: bit counts first, and of two classes only the pair that these bring nearest is intersected."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch[c].to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
            held, at = Bitmaps([*batch["bits_a"].to_pylist(), *batch["bits_b"].to_pylist()]), np.arange(batch.num_rows)
            most = most_shared(n_a, n_b, held.differing(at, at + batch.num_rows))
            out = batch.select(["a", "b", "of_a", "of_b"]).append_column("nearness", pa.array(most / (n_a + n_b)))
            yield out.filter(pa.array(_reaches(most, n_a, n_b, percent)))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["shingles_a"], batch["shingles_b"], strict=True):
                p, q = _unpack(x.as_py()), _unpack(y.as_py())
                keep.append(_reaches(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = materialize(pairs, "pairs")
    near = _both(sets, pairs, ["n", "bits"]).mapInArrow(bounded, "a long, b long, of_a long, of_b long, nearness double")
    near = near.groupBy(F.least("of_a", "of_b").alias("x"), F.greatest("of_a", "of_b").alias("y")).agg(F.max_by(F.struct("a", "b"), F.struct("nearness", "a", "b")).alias("p"))
    near = materialize(near.select("p.a", "p.b"), "near")
    return _both(sets, near, ["shingles"]).mapInArrow(exact, "a long, b long")


def _both(sets: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    rows = _of_nodes(sets, pairs.select(F.explode(F.array("a", "b")).alias("sig")), columns)
    for side in "ab":
        pairs = pairs.join(rows.select(F.col("sig").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs


def tiled(rows: DataFrame, weight: Column, most: int, percent: int) -> DataFrame:
    """rows(key, sig, n, component, ...) with `tile`: rows of a key and different classes that may link meet in a tile.

    Keys of up to `most` in weight are one tile. Larger ones are cut into tiles of a size band and the next, and those into
    blocks: rows of the largest class, which needn't meet each other, into blocks of one kind, all others into blocks of
    the other kind, and every block of the second kind meets all blocks. Keys of one class have no tile.
    """
    sizes = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum(weight).alias("k")).filter("low <> high").select("key", "k")
    live = materialize(rows.join(sizes, "key"), "live")
    hot = live.filter(F.col("k") > most)
    small = live.filter(F.col("k") <= most).drop("k").withColumn("tile", F.xxhash64("key"))
    band = F.floor(F.log(F.col("n")) / math.log(100 / percent) + 1e-9)
    hot = hot.drop("k").withColumn("band", F.explode(F.array(band, band + 1)))
    classes = hot.groupBy("key", "band", "component").agg(F.sum(weight).alias("w"))
    cut = classes.groupBy("key", "band").agg(F.max(F.struct("w", "component")).alias("top"), F.sum("w").alias("k"))
    cut = cut.select("key", "band", F.col("top.component").alias("major"), F.ceil(F.col("top.w") / most).alias("g"), F.ceil((F.col("k") - F.col("top.w")) / most).alias("h")).filter("h > 0")
    hot = hot.join(cut, ["key", "band"])
    own = F.col("component") == F.col("major")
    hot = hot.withColumn("block", F.pmod(F.xxhash64("sig"), F.when(own, F.col("g")).otherwise(F.col("h"))))

    def across(i: Column, j: Column) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), F.lit(True).alias("across"))

    minor = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j"), F.lit(False).alias("across")))
    meets = F.when(own, F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda j: across(F.col("block"), j))).otherwise(F.concat(F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda i: across(i, F.col("block"))), minor))
    hot = hot.withColumn("m", F.explode(meets)).withColumn("tile", F.xxhash64("key", "band", "m.i", "m.j", "m.across"))
    return small.unionByName(hot.select(*small.columns))


def _distinct(*columns: np.ndarray) -> list[np.ndarray]:
    order = np.lexsort(columns)
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return [c[new] for c in columns]


def _roots(pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers in pairs, sorted, and for each the smallest that the pairs connect it with."""
    names, at = np.unique(np.concatenate(pairs), return_inverse=True)
    a, b = at[: len(pairs[0])], at[len(pairs[0]) :]
    root = np.arange(len(names))
    while True:
        low, before = np.minimum(root[a], root[b]), root.copy()
        for x in (root[a], root[b], a, b):
            np.minimum.at(root, x, low)
        root = root[root]
        if (root == before).all():
            return names, names[root]


def compare_tiles(tiles: DataFrame, percent: int) -> DataFrame:
    """sig, n, component, cluster: nodes that places in prefixes and bit counts allow to link with a node of another class of their tile.

    Clusters join, by a number, the classes that may link; a node has one row for each task that finds it.
    """

    def run(table: pa.Table) -> pa.Table:
        tile, sig, n, rank, cls = (table[c].to_numpy().astype(np.int64) for c in ("tile", "sig", "n", "rank", "component"))
        order = np.lexsort((n, tile))
        raw = table["bits"].to_pylist()
        tile, sig, n, rank, cls, held = tile[order], sig[order], n[order], rank[order], cls[order], Bitmaps([raw[i] for i in order])
        del raw
        most = n - rank * n // 256  # nothing before the first shared shingle is shared
        marked, found = np.zeros(len(n), bool), []

        def meet(i: np.ndarray, j: np.ndarray) -> None:
            total = n[i] + n[j]
            near = (cls[i] != cls[j]) & ((100 + percent) * np.minimum(most[i], most[j]) >= percent * total)
            i, j = i[near], j[near]
            near = _reaches(most_shared(n[i], n[j], held.differing(i, j)), n[i], n[j], percent)
            if near.any():
                i, j = i[near], j[near]
                marked[i] = marked[j] = True
                found.append(_distinct(np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])))
                if sum(len(x[0]) for x in found) > 500_000:
                    found[:] = [_distinct(*map(np.concatenate, zip(*found, strict=True)))]

        for a, b in _tile_pairs(tile, n, cls, percent):
            meet(a, b)
        at = np.flatnonzero(marked)
        names, roots = _roots(tuple(map(np.concatenate, zip(*found, strict=True)))) if found else (np.zeros(0, np.int64),) * 2
        at = at[np.unique(sig[at], return_index=True)[1]]
        release_memory()
        return pa.table({"sig": pa.array(sig[at]), "n": pa.array(n[at].astype(np.int32)), "component": pa.array(cls[at]), "cluster": pa.array(roots[np.searchsorted(names, cls[at])])})

    return tiles.groupBy("part").applyInArrow(run, "sig long, n int, component long, cluster long")


def _tile_pairs(tile: np.ndarray, n: np.ndarray, cls: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i, j of rows of one tile, sorted by tile and n, whose sizes allow a link, many at a time: all pairs of small tiles, those with a node outside the largest class of others."""
    cuts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1], [True]]))
    size = np.repeat(np.diff(cuts), np.diff(cuts))
    i, step = np.flatnonzero(size <= SMALL_TILE), 1
    while len(i):
        i = i[i + step < len(tile)]
        within = (tile[i] == tile[i + step]) & (percent * n[i + step] <= 100 * n[i])
        i = i[within]
        yield i, i + step
        step += 1
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a > SMALL_TILE:
            _, place, times = np.unique(cls[a:b], return_inverse=True, return_counts=True)
            for x in a + np.flatnonzero(place != times.argmax()):
                low, high = a + np.searchsorted(n[a:b], [-(-percent * n[x] // 100), 100 * n[x] // percent + 1])
                j = np.arange(low, high)
                yield np.full(len(j), x), j


def exact_links(tiles: DataFrame, percent: int) -> DataFrame:
    """a, b: links between classes that some nodes of tiles(part, tile, n, component, shingles) have, a tree of them at most for each tile."""

    def run(table: pa.Table) -> pa.Table:
        tile, n, cls = (table[c].to_numpy().astype(np.int64) for c in ("tile", "n", "component"))
        order = np.lexsort((n, tile))
        tile, n, cls = tile[order], n[order], cls[order]
        raw = table["shingles"].to_pylist()
        arrays = [_unpack(raw[i]) for i in order]
        del raw
        sizes = np.minimum(4 * bitmap_size(n), BITMAP_MOST)
        data, at = bitmaps(np.concatenate(arrays), np.repeat(np.arange(len(n)), [len(x) for x in arrays]), sizes)
        held = Bitmaps([data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
        root, links = {int(c): int(c) for c in np.unique(cls)}, []

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for i, j in _tile_pairs(tile, n, cls, percent):
            apart = cls[i] != cls[j]
            i, j = i[apart], j[apart]
            most = most_shared(n[i], n[j], held.differing(i, j))
            order = np.argsort(-most / (n[i] + n[j]), kind="stable")
            for k in order[_reaches(most, n[i], n[j], percent)[order]]:
                p, q = top(int(cls[i[k]])), top(int(cls[j[k]]))
                if p != q:
                    x, y = arrays[i[k]], arrays[j[k]]
                    if _reaches(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent):
                        root[max(p, q)] = min(p, q)
                        links.append((int(cls[i[k]]), int(cls[j[k]])))
        release_memory()
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return tiles.groupBy("part").applyInArrow(run, "a long, b long")


def _parts(tiles: DataFrame, many: int) -> DataFrame:
    return tiles.withColumn("part", F.pmod(F.col("tile"), F.lit(many)))


def _edges(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("node").alias("a"), F.col("component").alias("b"))


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs(doc_id, text); other columns are ignored.

    A-Z count as lower case; words are runs without space and \\x09-\\x0D. A text shorter than width words has one shingle, a
    null or empty text or one of white space none; it links with nothing. component_id is the smallest doc_id that links
    reach. Rows that repeat a doc_id are texts of their own with that id; a null doc_id takes part in links and is never the
    smallest, unless all of a class are null. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    sets = materialize(shingle_sets(docs, width), "sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    labels, first = None, 0
    for many in WAVES:
        links = verify(sets, star_pairs(sets, labels, first, first + many), percent)
        labels = materialize(components(links if labels is None else links.unionAll(_edges(labels))), "labels")
        first += many
    rows = materialize(prefix_rows(sets, percent, total), "prefixes")
    tiles = tiled(_labelled(rows, labels).withColumnRenamed("shingle", "key"), F.lit(1), BLOCK, percent)
    tiles = tiles.join(_of_nodes(sets, tiles.select("sig"), ["bits"]), "sig")
    near = materialize(compare_tiles(_parts(tiles, max(64, rows.count() // TILE_ROWS)), percent), "near")
    discard(rows)
    clusters = materialize(components(near.select(F.col("component").alias("a"), F.col("cluster").alias("b"))), "clusters")
    nodes = near.select("sig", "n", "component").distinct().join(clusters.select(F.col("node").alias("component"), F.col("component").alias("key")), "component")
    tiles = tiled(nodes, F.col("n"), ARRAYS_TOGETHER, percent)
    weight = nodes.agg(F.sum("n")).first()[0] or 0
    tiles = tiles.join(_of_nodes(sets, tiles.select("sig"), ["shingles"]), "sig")
    links = exact_links(_parts(tiles, max(64, weight // CLUSTER_TASK)), percent)
    labels = materialize(components(links.unionAll(_edges(labels))), "labels")
    out = _labelled(sets.filter("sig is not null").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "sig"), labels)
    out = materialize(out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).alias("component")), "classes")
    discard(sets)
    smallest = out.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return out.join(smallest, "component", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_copies(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """docs without the rows that are near copies of another one: of each class the row with the smallest doc_id stays.

    Rows count one by one: of rows with one doc_id and text one stays, whichever; rows with one doc_id and different texts
    don't drag each other along; a null doc_id comes last in its class. Rows without words all stay. Columns are kept.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text"), percent, width).select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row))
    groups = materialize(groups.join(keyed.select(row, "doc_id"), row), "groups")
    first = groups.groupBy("component_id").agg(F.min_by(row, order).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    gone = groups.join(first, "component_id").filter(F.col(row) != F.col("_first")).select(row)
    return keyed.join(gone, row, "left_anti").select(*docs.columns)
