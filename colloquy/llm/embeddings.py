"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables and a rerank with the original vectors.

ITQ learns rotations, from a bounded sample, that make the signs of the rotated vectors balanced codes with little
quantisation error. Codes are cut into substrings, one table each; of vectors of a label whose codes agree in a substring,
those within a Hamming radius are compared by their exact cosine. The width of substrings follows the number of vectors, so
that buckets stay small. The number of rotations and the radius are set by trial: pairs at the threshold are made from the
sample, off in directions of chance and in those in which the data differ, and rotations are added until at most one in 200
of them is missed. Equal vectors are one node. A bucket of more than BLOCK nodes becomes tiles of block pairs, so no task gets
a whole large group.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.graph import components
from colloquy.storage import bound_batches, discard, materialize

#: Vectors that ITQ learns from at most.
SAMPLE = 20_000
BITS, BLOCK, BUCKET = 64, 512, 32
#: Rotations at most. More than these are needed by vectors that hardly differ from their mean; what share of trial pairs is missed then is reported by a warning.
MOST_ROTATIONS = 64
ROWS_TOGETHER = 20_000
_ROWS = "label long, dim int, tab int, code long, node long, mult long, parts binary, vector binary"


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn_rotation(centred: np.ndarray, basis: np.ndarray, rng: np.random.Generator, rounds: int = 50) -> np.ndarray:
    """A matrix (dimensions, bits) whose signs are the codes: principal directions, rotated by ITQ from a start of chance."""
    v = centred @ basis
    r = np.linalg.qr(rng.standard_normal((basis.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return basis @ r


def trial_pairs(x: np.ndarray, cosine: float, rng: np.random.Generator, n: int = 2000) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two sets of pairs of unit vectors at the cosine: vectors of x, moved in directions of chance and towards other vectors of x."""
    own = x[rng.integers(0, len(x), n)]
    out = []
    for away in (rng.standard_normal(own.shape), x[rng.integers(0, len(x), n)] - x[rng.integers(0, len(x), n)]):
        away = away - (away * own).sum(1, keepdims=True) * own
        size = np.linalg.norm(away, axis=1, keepdims=True)
        some = size[:, 0] > 1e-9
        out.append((own[some], (cosine * own + math.sqrt(max(1 - cosine * cosine, 0.0)) * away / np.maximum(size, 1e-12))[some]))
    return [p for p in out if len(p[0])]


@dataclass
class Codes:
    """What ITQ learned: mean, rotations, bits of a substring, and the largest Hamming distance (all rotations together) that is looked at."""

    mean: np.ndarray
    turns: np.ndarray
    width: int
    per: int
    radius: int

    def signs(self, unit_vectors: np.ndarray) -> np.ndarray:
        """(vectors, tables, bits of a substring) of vectors of length 1."""
        bits = self.turns.shape[1] // self.rotations
        out = ((unit_vectors - self.mean) @ self.turns >= 0).reshape(len(unit_vectors), self.rotations, bits)
        return out[:, :, : self.per * self.width].reshape(len(unit_vectors), self.per * self.rotations, self.width)

    @property
    def rotations(self) -> int:
        return self.turns.shape[1] // min(BITS, len(self.mean))


def learn(x: np.ndarray, vectors: int, cosine: float, misses: float = 0.005, seed: int = 5) -> Codes:
    """Codes for as many vectors of a label, from a sample x."""
    rng = np.random.default_rng(seed)
    x = _unit(x)
    mean = x.mean(0)
    centred = x - mean
    values, directions = np.linalg.eigh(centred.T @ centred)
    basis = directions[:, np.argsort(values)[::-1][:BITS]]
    bits = basis.shape[1]
    width = min(bits, 32, max(8, math.ceil(math.log2(max(vectors, 1) / BUCKET)) if vectors > BUCKET else 8))
    trials, turns = trial_pairs(x, cosine, rng), []
    while True:
        turns.append(learn_rotation(centred, basis, rng))
        codes = Codes(mean, np.concatenate(turns, 1), width, bits // width, 0)
        missed, far = 0.0, 0
        for a, b in trials:
            differ = codes.signs(a) != codes.signs(b)
            hit = (~differ.any(2)).any(1)
            missed = max(missed, 1 - hit.mean())
            distance = differ.sum((1, 2))
            far = max(far, math.ceil(np.quantile(distance, 0.999) + 2 * distance.std()))
        codes.radius = far
        if missed > misses and len(turns) == MOST_ROTATIONS and vectors > BUCKET:  # smaller labels are compared whole
            warnings.warn(f"{missed:.2%} of trial pairs at cosine {cosine} share no table of {len(mean)} dimensions; about as many links may be missed", stacklevel=2)
        if missed <= misses or len(turns) == MOST_ROTATIONS:
            return codes


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, offsets and lengths of a list column."""
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values), offsets, np.diff(offsets)


def coded(nodes: DataFrame, codes: Codes) -> DataFrame:
    """A row of _ROWS for each table of each of nodes(node, label, mult, embedding), all of the codes' dimension. Vectors of small labels share one bucket a label."""
    held = nodes.sparkSession.sparkContext.broadcast(codes)
    tables = codes.per * codes.rotations
    weights = np.int64(1) << np.arange(codes.width, dtype=np.int64)
    kind = "<f8" if nodes.schema["embedding"].dataType.elementType.simpleString() == "double" else "<f4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = held.value
        mean = codes.mean
        for batch in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
            values, offsets, sizes = _matrix(batch.column(3))
            coded_ = (sizes == len(mean)) & ~batch.column(4).to_numpy(zero_copy_only=False)
            fits = np.flatnonzero(coded_)
            parts = np.zeros((len(sizes), tables), np.int64)
            if len(fits):
                x = values[offsets[fits][:, None] + np.arange(len(mean))].astype(float)
                x = _unit(x)
                parts[fits] = (codes.signs(x) * weights).sum(2)
            vectors = [values[a:b].astype(kind).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            own = [p.astype("<i8").tobytes() for p in parts]
            for t in range(tables):
                use = np.ones(len(sizes), bool) if t == 0 else coded_
                some = pa.array(use)
                columns = [batch.column(1), pa.array(sizes, pa.int32()), pa.array(np.full(len(sizes), t), pa.int32()), pa.array(parts[:, t]), batch.column(0), batch.column(2), pa.array(own, pa.binary()), pa.array(vectors, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _ROWS.split(", ")]).filter(some)

    many = nodes.groupBy("label").agg((F.count("*") <= BUCKET).alias("small"))
    return nodes.join(many, "label").select("node", "label", "mult", "embedding", "small").mapInArrow(run, _ROWS)


def tiled(rows: DataFrame) -> DataFrame:
    """rows with block and tile: in buckets of more than BLOCK nodes, each block of nodes meets each other block, and itself, in one tile."""
    key = F.xxhash64("label", "dim", "tab", "code")
    large = materialize(rows.select(key.alias("bucket")).groupBy("bucket").count().filter(F.col("count") > BLOCK), "large")
    out = rows.withColumn("bucket", key).join(large, "bucket", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("count") / (BLOCK // 2)), F.lit(1)).cast("int"))
    out = out.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
    return out.withColumn("tile", tile).drop("count", "other")


def compare(tiles: DataFrame, cosine: float, parts: int, radius: int, kind: str) -> DataFrame:
    """node, n (partners with their copies) and partner: sums over tiles. A pair counts in the first table where its codes agree; partners join a tile's nodes into trees."""

    def groups(table: pa.Table) -> Iterator[tuple[np.ndarray, int]]:
        bucket, tile = table["bucket"].to_numpy(), table["tile"].to_numpy()
        order = np.lexsort((tile, bucket))
        b, t = bucket[order], tile[order]
        cuts = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (t[1:] != t[:-1]), [True]]))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if j - i > 1:
                yield order[i:j]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, mult, tab, block = (table[c].to_numpy() for c in ("node", "mult", "tab", "block"))
        label, dim, code = (table[c].to_numpy() for c in ("label", "dim", "code"))
        vectors, codes = table["vector"].to_pylist(), table["parts"].to_pylist()
        nodes, counts, partners = [], [], []
        for at in groups(table):
            at = at[[len(vectors[i]) == len(vectors[at[0]]) for i in at]]  # hashes of buckets may be equal by chance
            own = np.stack([np.frombuffer(codes[k], "<i8") for k in at])
            bits = np.unpackbits(own.view(np.uint8), axis=1).astype(np.float32)
            ones = bits.sum(1)
            near = np.triu(ones[:, None] + ones - 2 * (bits @ bits.T) <= radius, 1)
            if block[at].min() != block[at].max():  # pairs within a block have a tile of their own
                near &= block[at][:, None] != block[at]
            near &= (label[at][:, None] == label[at]) & (dim[at][:, None] == dim[at]) & (code[at][:, None] == code[at])
            i, j = np.nonzero(near)
            t = int(tab[at[0]])
            first = (own[i, :t] != own[j, :t]).all(1)
            i, j = i[first], j[first]
            x = np.stack([np.frombuffer(vectors[k], kind) for k in at]).astype(float)
            x = x / np.abs(x).max(1, keepdims=True)
            norm = np.linalg.norm(x, axis=1)
            link = np.concatenate([np.einsum("kd,kd->k", x[i[k : k + 20_000]], x[j[k : k + 20_000]]) / (norm[i[k : k + 20_000]] * norm[j[k : k + 20_000]]) >= cosine for k in range(0, len(i), 20_000)]) if len(i) else np.zeros(0, bool)
            i, j = np.concatenate([i[link], j[link]]), np.concatenate([j[link], i[link]])
            if not len(i):
                continue
            total = np.bincount(i, mult[at][j], len(at))
            link = np.zeros((len(at), len(at)), bool)
            link[i, j] = True
            lowest = np.arange(len(at))
            while True:
                new = np.minimum(lowest, np.where(link, lowest, len(at)).min(1))
                new = new[new]
                if (new == lowest).all():
                    break
                lowest = new
            some = np.flatnonzero(total)
            nodes.append(node[at][some])
            counts.append(total[some])
            partners.append(node[at][lowest[some]])
        n = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        return pa.table({"node": pa.array(n), "n": pa.array((np.concatenate(counts) if counts else n).astype(np.int64)), "partner": pa.array(np.concatenate(partners) if partners else n)})

    return tiles.withColumn("part", F.pmod(F.xxhash64("bucket", "tile"), F.lit(parts))).groupBy("part").applyInArrow(run, "node long, n long, partner long")


def usable(embedding: Column) -> Column:
    """Neither null nor zero, without null, infinite or NaN components."""
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(embedding.isNotNull() & ~bad & F.exists(embedding, lambda v: v != 0), F.lit(False))


def _found(nodes: DataFrame, cosine: float, kind: str) -> DataFrame:
    """The rows of compare for nodes of one dimension, which get codes of their own."""
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("embedding").toArrow()
    sample = np.array(sample["embedding"].to_pylist(), float)
    codes = learn(sample, nodes.groupBy("label").count().agg(F.max("count")).first()[0], cosine)
    tables = materialize(coded(nodes, codes), "tables")
    found = materialize(compare(tiled(tables), cosine, max(96, tables.count() // ROWS_TOGETHER), codes.radius, kind), "found")
    discard(tables)
    return found


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors(vec_id, embedding, label); other columns are ignored.

    embedding is an array of float or double, label of any type that can be hashed; vec_id is a whole number.

    Rows link if their labels are equal and not null, their dimensions equal and their cosine, in double precision, is at
    least the threshold. Rows whose vector is null, zero or has a null or non-finite component link with nothing, and are
    their own component. Vectors of each dimension are indexed by codes of their own, one dimension after the other. Rows
    that repeat a vec_id are vectors of their own. An empty table gives no rows. A share of missed trial pairs that stays
    above one in 200 is reported by a warning.
    """
    bound_batches(vectors.sparkSession)
    double = vectors.schema["embedding"].dataType.elementType.simpleString() == "double"
    label = F.when(F.col("label").isNotNull(), F.xxhash64("label")).alias("label")
    rows = vectors.select("vec_id", label, F.col("embedding").cast(f"array<{'double' if double else 'float'}>").alias("embedding"))
    node = F.when(F.col("label").isNotNull() & usable(F.col("embedding")), F.xxhash64("label", "embedding"))
    rows = materialize(rows.withColumn("node", node), "vectors")
    valid = rows.filter("node is not null")
    nodes = materialize(valid.groupBy("node").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("mult")), "nodes")
    dimensions = [r["d"] for r in nodes.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect()]  # a row for each dimension
    if not dimensions:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    parts = [_found(nodes.filter(F.size("embedding") == d) if len(dimensions) > 1 else nodes, cosine, "<f8" if double else "<f4") for d in dimensions]
    found = reduce(DataFrame.unionByName, parts)
    sums = found.groupBy("node").agg(F.sum("n").alias("n"))
    labels = components(found.select(F.col("node").alias("a"), F.col("partner").alias("b")))
    ids = valid.groupBy("node").agg(F.min("vec_id").alias("first"), F.count("*").alias("mult"))
    ids = ids.join(sums, "node", "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = materialize(ids, "ids")
    first = ids.groupBy("component").agg(F.min("first").alias("component_id"))
    each = ids.join(first, "component").select("node", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").join(each, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
