"""Embedding whitening: principal components by matrix-free block subspace iteration.

The covariance is never formed on the way: each pass over the rows computes X'(XQ)/n for a block Q of vectors, the driver
takes its Rayleigh-Ritz pairs and the QR of what they were mapped to as the next block. A pass ends the iteration once
the residual of every wanted component certifies it. Where the residuals fall too slowly, because the spectrum is flat
just beyond the block, the block is widened by vectors of chance; at most it spans the whole space, where one pass settles
all. Only blocks (dimension x width) reach the driver, whatever the number of rows.

Entries are whole numbers on a grid, so sums, means and deviations are exact, and rows are centred without cancellation:
the whole part of the mean is taken off as whole numbers, the rest as a fraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.storage import bound_batches, materialize

SCALE, SHIFT = 64, 1_000_000
#: Residual of a component, as a share of the largest eigenvalue, that certifies it.
TOLERANCE = 1e-14
#: A pass that doesn't bring the residual down by this factor makes the block wider.
FALL = 20.0
#: Tables of partial sums that reach the driver at most.
PARTIALS = 16
ROWS_TOGETHER = 4_000
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def on_grid(embedding: Column) -> Column:
    """Entries as whole numbers floor(64 c) + 1,000,000; null for a vector that is null or empty, holds a null or non-finite entry or one beyond 2^46, where doubles have no grid of 64ths."""
    e = embedding.cast("array<double>")
    bad = F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > float(1 << 46)))
    return F.when(e.isNotNull() & (F.size(e) > 0) & ~bad, F.transform(e, lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("long")))


class Mean:
    """n and exact sums S of the fit list; centring takes off whole and rest of S/n one after the other."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s - n * (s // n) for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact; None where one doesn't fit in 64 bits."""
        y = x - self.whole
        most = max(abs(int(y.min(initial=0))), int(y.max(initial=0)), 1) + 1
        if (most * self.n) ** 2 * x.shape[1] < 1 << 63:
            y = y * self.n - self.rest
            return (y * y).sum(1).tolist()
        exact = [sum((int(v) * self.n - int(r)) ** 2 for v, r in zip(row, self.rest, strict=True)) for row in y]
        return [v if v < 1 << 63 else None for v in exact]


def _summed(fit: DataFrame, d: int, shape: tuple[int, ...], partial, kind: type = np.float64) -> np.ndarray:
    """The sum of partial(rows) over all rows of fit(x): by batch, by task, by PARTIALS groups of tasks and on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(shape, kind), False
        for batch in batches:
            x = _vectors(batch.column(0), d)
            for i in range(0, len(x), ROWS_TOGETHER):
                total += partial(x[i : i + ROWS_TOGETHER])
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % PARTIALS], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "total"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(shape, kind)
        for raw in table["total"]:
            total += np.frombuffer(raw.as_buffer(), kind).reshape(shape)
        return pa.table({"total": pa.array([total.tobytes()], pa.binary())})

    parts = fit.select("x").mapInArrow(run, "slot int, total binary").groupBy("slot").applyInArrow(add, "total binary")
    return sum((np.frombuffer(r.total, kind).reshape(shape) for r in parts.collect()), np.zeros(shape, kind))  # at most PARTIALS rows


def fit_mean(fit: DataFrame, d: int) -> Mean:
    """Exact sums of the columns: those of the upper and of the lower bits of entries fit in 64 bits, and meet as Python's whole numbers."""

    def halves(x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x >> 26).sum(0), (x & ((1 << 26) - 1)).sum(0), [len(x)]])

    total = _summed(fit, d, (2 * d + 1,), halves, np.int64).tolist()
    return Mean(total[-1], [(high << 26) + low for high, low in zip(total[:d], total[d:-1], strict=True)])


def subspace(fit: DataFrame, d: int, mean: Mean, k: int, seed: int = 11, most: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of the covariance of fit(x), k of them or as many as it has, and its trace."""
    rng = np.random.default_rng(seed)
    width = min(d, 2 * k)
    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    before, trace = np.inf, None
    for _ in range(most):
        held = fit.sparkSession.sparkContext.broadcast(q)

        def partial(x: np.ndarray, held=held) -> np.ndarray:
            c = mean.centred(x)
            return np.concatenate([c.T @ (c @ held.value), (c * c).sum(0)[:, None]], 1)

        total = _summed(fit, d, (d, q.shape[1] + 1), partial) / mean.n
        held.destroy()
        y, trace = total[:, :-1], float(total[:, -1].sum())
        if trace == 0:
            return np.zeros(0), np.zeros((d, 0)), 0.0
        h = q.T @ y
        values, turns = np.linalg.eigh((h + h.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        ritz, mapped = q @ turns, y @ turns
        # what is left of eigenvalues under the rounding of the sums isn't a component
        real = min(k, int((values > 64 * d * np.finfo(float).eps * values[0]).sum()))
        residual = float(np.linalg.norm(mapped[:, :real] - ritz[:, :real] * values[:real], axis=0).max() / values[0])
        if residual <= TOLERANCE * max(1.0, np.sqrt(d)):
            return values[:real], ritz[:, :real], trace
        if q.shape[1] < d and before / residual < FALL:
            extra = min(d - q.shape[1], q.shape[1])
            mapped = np.concatenate([mapped, values[0] * rng.standard_normal((d, extra)) / np.sqrt(d)], 1)
        before = residual
        q = np.linalg.qr(mapped)[0]
    raise ArithmeticError(f"components have no certificate after {most} passes: residual {residual:.3g} of the largest eigenvalue")


def whiten(vectors: DataFrame, k: int = 16) -> DataFrame:
    """A row for each usable vector of vectors(vec_id, embedding) and each component up to k: vec_id, component, n, deviation, whitened, explained and identity_error; other columns are ignored.

    Vectors that are null or empty, or hold a null or non-finite entry (or one beyond 2^46), have no rows. The fit list holds
    each distinct vector once, so copies, however many, count once; repeated rows and null ids have rows of their own. A
    covariance of lower rank has fewer components; one of rank zero, as of a single vector, has none, so no rows come. Vectors
    of each dimension are fitted by themselves. A deviation beyond 64 bits is null. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), on_grid(F.col("embedding")).alias("x")).filter("x is not null")
    distinct = materialize(rows.select("x").distinct(), "fit")
    sizes = sorted(r["d"] for r in distinct.select(F.size("x").alias("d")).distinct().collect())  # a row for each dimension
    out = spark.createDataFrame([], _OUT)
    for d in sizes:
        fit = distinct.filter(F.size("x") == d) if len(sizes) > 1 else distinct
        mean = fit_mean(fit, d)
        values, components, trace = subspace(fit, d, mean, min(k, d))
        if not len(values):
            continue
        weights = components / np.sqrt(values)

        def squares(x: np.ndarray, mean=mean, weights=weights) -> np.ndarray:
            w = mean.centred(x) @ weights
            return w.T @ w

        error = float(np.abs(_summed(fit, d, (len(values),) * 2, squares) / mean.n - np.eye(len(values))).max())
        held = spark.sparkContext.broadcast((mean, weights, values / trace))

        def project(batches: Iterator[pa.RecordBatch], d=d, held=held, error=error) -> Iterator[pa.RecordBatch]:
            mean, weights, shares = held.value
            many = len(shares)
            for batch in (b.slice(i, ROWS_TOGETHER) for b in batches for i in range(0, b.num_rows, ROWS_TOGETHER)):
                x = _vectors(batch.column(1), d)
                each = np.repeat(np.arange(len(x)), many)
                deviations = pa.array(mean.deviations(x), pa.int64())
                columns = [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, many + 1), len(x)), pa.int32()), pa.array(np.full(len(each), mean.n)), deviations.take(pa.array(each)), pa.array((mean.centred(x) @ weights).ravel()), pa.array(np.tile(shares, len(x))), pa.array(np.full(len(each), error))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _OUT.split(", ")])

        out = out.unionByName(rows.filter(F.size("x") == d).select("vec_id", "x").mapInArrow(project, _OUT))
    return out
