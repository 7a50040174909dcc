"""Whitening against a plain eigendecomposition; exact sums against whole numbers."""

import math
from collections import defaultdict

import numpy as np
import pytest

from colloquy.llm import queries
from colloquy.llm.whitening import whiten


def brute(vectors, k):
    """n, {id: deviation}, eigenvalues, components, trace and {id: centred vector}."""
    kept = {i: [math.floor(64 * c) + 1_000_000 for c in map(float, v)] for i, v in vectors.items() if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted(set(map(tuple, kept.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for i, x in kept.items()}
    centred = {i: np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)]) for i, x in kept.items()}
    rows = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    cov = rows.T @ rows / n
    e, v = np.linalg.eigh(cov)
    return n, deviation, e[::-1][:k], v[:, ::-1][:, :k], np.trace(cov), centred


def check(got, vectors, k):
    n, deviation, e, v, trace, centred = brute(vectors, k)
    by = defaultdict(dict)
    for r in got:
        assert r.n == n and r.deviation == deviation[r.vec_id]
        by[r.vec_id][r.component] = r
    assert set(by) == set(centred)
    k = int((e > 1e-9 * e[0]).sum())
    for c in range(1, k + 1):
        want = {i: float(x @ v[:, c - 1]) / math.sqrt(e[c - 1]) for i, x in centred.items()}
        largest = max(want, key=lambda i: abs(want[i]))
        sign = 1 if want[largest] * by[largest][c].whitened > 0 else -1
        assert all(abs(sign * want[i] - by[i][c].whitened) < 1e-8 * max(1, abs(want[largest])) for i in want)
        assert all(abs(by[i][c].explained - e[c - 1] / trace) < 1e-10 for i in want)
    assert all(set(x) == set(range(1, k + 1)) for x in by.values()) and all(r.identity_error < 1e-10 for r in got)


@pytest.mark.parametrize("kind", ["flat", "falling", "narrow"])
def test_against_eigh(spark, kind):
    rng = np.random.default_rng(7)
    d = {"flat": 40, "falling": 60, "narrow": 5}[kind]
    x = rng.standard_normal((400, d)) * (0.8 ** np.arange(d) if kind == "falling" else 1) * 3
    vectors = {i: v.tolist() for i, v in enumerate(x)}
    vectors |= {1000: None, 1001: [float("nan")] * d, 1002: [None] * d, 1003: [float("inf")] * d} | {2000 + i: vectors[0] for i in range(150)}
    rows = spark.createDataFrame([(i, v, 3, 1) for i, v in vectors.items()], "vec_id long, embedding array<double>, n int, x int").repartition(5)
    check(whiten(rows, 8).collect(), vectors, 8)


def test_low_rank_odd_rows_and_dimensions(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(-5, 6, (60, 2)) @ np.array([[1, 0, 1, 0, 2], [0, 1, 0, 1, 1]])
    vectors = {i: v.astype(float).tolist() for i, v in enumerate(base)}
    rows = [(i, v) for i, v in vectors.items()]
    check(whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect(), vectors, 5)
    other = [(100 + i, [float(i), 1.0]) for i in range(4)] + [(200, []), (None, vectors[0]), (201, [1e300] * 5)]
    got = whiten(spark.createDataFrame(rows + other, "vec_id long, embedding array<double>")).collect()
    check([r for r in got if r.vec_id is not None and r.vec_id < 100], vectors, 5)
    assert {r.vec_id for r in got} == {*vectors, 100, 101, 102, 103, None} and {r.component for r in got if r.vec_id == 101} == {1}


def test_no_spread_no_rows(spark):
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).count() == 0
    assert whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_large_deviations_are_exact(spark):
    vectors = {1: [1e9, 0.0], 2: [-1e9, 3.0], 3: [0.25, 1.0]}
    got = whiten(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")).collect()
    deviation = brute(vectors, 2)[1]
    assert {r.vec_id: r.deviation for r in got} == {i: v if v < 1 << 63 else None for i, v in deviation.items()} and None in {r.deviation for r in got}


def test_query_on_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    check(queries.op13_subspace_whitening(spark, "/root/testdata/sf0.001").collect(), {r.vec_id: r.embedding for r in rows}, 16)
