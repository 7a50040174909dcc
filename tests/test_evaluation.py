"""Percentiles, medians, centroids and fronts against plain Python: outliers, ties, null keys, tables of many centroids."""

import random

import numpy as np
import pytest

from colloquy.operators import evaluation as ev
from colloquy.operators import intervals as iv
from colloquy.operators import sessions as ss


def keyed(seed, n):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, 1e12, *map(float, range(40))]) if i % 3 else rng.random()) for i in range(n)]
    return [*rows, ("one", 5.0), ("none", None)]


@pytest.mark.parametrize("n", [30, 4000])
def test_percentiles_with_an_outlier_ties_and_null_keys(spark, n):
    rows = keyed(n, n)
    got = {r.k: r for r in ev.percentiles(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v", {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for k, r in got.items():
        own = [v for kk, v in rows if kk == k and v is not None]
        assert np.allclose([r.p0, r.p1, r.p50, r.p95, r.p100], np.quantile(own, [0, 0.01, 0.5, 0.95, 1]), rtol=1e-12)


@pytest.mark.parametrize("n", [1, 7, 500])
def test_weighted_median(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice(["a", None]), rng.choice([1e15, *range(100)]), rng.randrange(1, 9)) for _ in range(n)]
    rows = [(k, float(v), w) for k, v, w in rows]
    got = {r.k: r.weighted_median for r in ev.weighted_median(spark.createDataFrame(rows, "k string, v double, w long"), ["k"], "v", "w").collect()}
    for k in {r[0] for r in rows}:
        own, run = sorted((v, w) for kk, v, w in rows if kk == k), 0
        for v, w in own:
            run += w
            if 2 * run >= sum(x[1] for x in own):
                break
        assert got[k] == v
    assert set(got) == {r[0] for r in rows}


@pytest.mark.parametrize("sent", [True, False])
def test_nearest_of_many_centroids(spark, monkeypatch, sent):
    rng = np.random.default_rng(2)
    centers, x = rng.standard_normal((60, 5)), rng.standard_normal((90, 5))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    centers[7] = centers[3]
    if not sent:
        monkeypatch.setattr(ev, "SENT_BYTES", 0)
        monkeypatch.setattr(ev, "CENTROIDS_TOGETHER", 16)
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "k long, centroid array<double>")
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [0.0] * 5), (92, [1.0, 2.0]), (93, [float("nan")] * 5)]
    got = {r.i: r for r in ev._similarities(spark.createDataFrame(rows, "i long, e array<double>").repartition(4), table, "k", "e").collect()}
    near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ centers.T
    for i in range(90):
        order = sorted(range(60), key=lambda k: (-round(near[i, k], 12), k))
        assert (got[i]._c1, got[i]._c2) == (order[0], order[1]) and abs(got[i]._s1 - near[i, order[0]]) < 1e-12
    assert all(got[i]._c1 is None and got[i]._s1 is None for i in (90, 91, 92, 93)) and len(got) == 94
    lead = {r.i: r.assigned for r in ev.nearest_centroid(spark.createDataFrame(rows, "i long, e array<double>"), table, "k", "e", 0.5, 0.1).collect()}
    for i in range(90):
        first, second = sorted(near[i], reverse=True)[:2]
        assert (lead[i] is not None) == (first >= 0.5 and first - second >= 0.1)


@pytest.mark.parametrize("parts", [4, 256])
def test_front_against_a_loop(spark, parts):
    rng = random.Random(parts)
    rows = [(i, rng.choice([None, 1.0, 1.0, 1.0, *map(float, range(30))]), rng.choice([None, *range(20)]), rng.randrange(20)) for i in range(400)]
    got = {r.i for r in ss.pareto(spark.createDataFrame(rows, "i long, risk double, g long, h long"), "risk", ["g", "h"], "i", parts).collect()}
    want, best = set(), [None, None]
    for i, risk, g, h in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is None, -(r[2] or 0), -r[3], r[0])):
        if any(v is not None and (b is None or v > b) for v, b in zip((g, h), best, strict=True)):
            want.add(i)
        best = [max((x for x in (b, v) if x is not None), default=None) for b, v in zip(best, (g, h), strict=True)]
    assert got == want


def test_null_keys_stay_in_buckets(spark):
    rows = spark.createDataFrame([(None, 1, 0, 10), (None, 2, 20, 30), ("a", 3, 0, 5)], "k string, id long, start long, end long")
    assert {r.k: r.union_length for r in iv.union_length(rows, ["k"]).collect()} == {None: 20, "a": 5}
    assert {(r.k, r.start, r.end) for r in iv.difference(rows, rows.filter("id = 1").withColumn("end", rows["end"] - 4), ["k"]).collect()} == {(None, 6, 10), (None, 20, 30), ("a", 0, 5)}
    assert {r.id: r.before for r in iv.lagged(rows, ["k"], ["start", "id"], {"before": "id"}).collect()} == {1: None, 2: 1, 3: None}
    runs = iv.runs(rows, ["k"], ["start", "id"], "end").collect()
    assert len(runs) == 3 and {r.k for r in runs} == {None, "a"}
    near = iv.nearest(rows.filter("id = 2"), rows.filter("id <> 2"), ["k"], "start", "id").collect()
    assert near[0].near.id == 1


def test_overlaps_over_midnight(spark):
    day = 86_400_000
    left = spark.createDataFrame([(1, day - 1000, day + 5000)], "id long, start long, end long")
    right = spark.createDataFrame([(2, day + 1000, day + 2000), (3, day + 6000, day + 7000)], "id long, start long, end long")
    assert [r.r.id for r in iv.overlap_join(left, right, [], 60_000).collect()] == [2]
