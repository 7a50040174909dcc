"""Dendrograms, replays and choices against plain loops over full distance tables; all folds at once against one fit for each."""

import random
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators import linkage as lk
from colloquy.operators import speakers
from colloquy.plans import catalogue, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def plain(x, cut):
    """Labels (smallest member) of merging the nearest pair, all mean distances counted anew each time."""
    x, clusters = unit(np.asarray(x, float)), [[i] for i in range(len(x))]
    while len(clusters) > 1:
        best = min((round(float(np.mean([1 - x[i] @ x[j] for i in a for j in b])), 12), a[0], b[0]) for a, b in combinations(sorted(clusters), 2))
        if best[0] > cut:
            break
        a, b = (next(c for c in clusters if c[0] == k) for k in best[1:])
        clusters = [c for c in clusters if c not in (a, b)] + [sorted(a + b)]
    return {i: c[0] for c in clusters for i in c}


def rand_index(a, b):
    """Adjusted, over all pairs of items."""
    pairs = list(combinations(sorted(a), 2))
    same = [sum(x[i] == x[j] for i, j in pairs) for x in (a, b)]
    both = sum(a[i] == a[j] and b[i] == b[j] for i, j in pairs)
    if not pairs or (same[0] + same[1]) / 2 == same[0] * same[1] / len(pairs):
        return 1.0
    expected = same[0] * same[1] / len(pairs)
    return (both - expected) / ((same[0] + same[1]) / 2 - expected)


def voices(seed, n, speakers_=4, d=6):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((speakers_, d))
    x = middle[rng.integers(0, speakers_, n)] + 0.4 * rng.standard_normal((n, d))
    x[5] = x[3] = x[1]  # ties
    return x


@pytest.mark.parametrize("block", [1000, 8])
def test_every_cut_of_the_tree_is_that_of_merging_pairs(spark, block):
    x = {m: voices(m, n) for m, n in ((0, 40), (1, 23), (2, 6))}
    rows = [(m, i, v.tolist()) for m, vs in x.items() for i, v in enumerate(vs)] + [(3, 0, [1.0, 0.0]), (3, 1, None), (3, 2, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "m long, k long, e array<double>").repartition(4)
    grid = [0.0, 0.05, 0.1, 0.3, 0.6, 1.0]
    got = {(r.m, r.distance, r.k): r["first"] for r in lk.cut(frame, lk.dendrogram(frame, ["m"], "k", "e", block), ["m"], "k", grid).collect()}
    for m, vs in x.items():
        for d in grid:
            assert {k: got[m, d, k] for k in range(len(vs))} == plain(vs, d)
    assert {k: got[3, 1.0, k] for k in range(3)} == {0: 0, 1: 1, 2: 2}


def test_two_thousand_units_and_more_are_no_error(spark):
    rng = np.random.default_rng(4)
    middle = unit(rng.standard_normal((5, 16)))
    of = rng.integers(0, 5, 2600)
    x = middle[of] + 0.05 * rng.standard_normal((2600, 16))
    frame = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "m long, k long, e array<double>")
    got = {r.k: r.cluster for r in lk.agglomerative(frame, "m", "k", "e", 0.3).collect()}
    assert len(got) == 2600 and len(set(got.values())) == 5 and len({(got[i], int(of[i])) for i in got}) == 5 and got[0] == 0


def test_replay_and_candidates_against_plain_loops(spark):
    x = {m: voices(10 + m, 30, 3) for m in range(3)}
    rows = [(m, i, v.tolist(), 10.0 * i, 10.0 * i + 4) for m, vs in x.items() for i, v in enumerate(vs)]
    frame = spark.createDataFrame(rows, "m long, k long, e array<double>, start double, end double")
    grid, least = [0.1, 0.2, 0.3], (3, 5, 20, 0.3)
    got = {(r.m, r.distance): r for r in lk.partition_candidates(frame, "m", "k", "e", "start", "end", grid, 100, 0.15, least).collect()}
    for m, vs in x.items():
        u = unit(vs)
        for d in grid:
            whole, replay, heads = plain(vs, d), {}, {}
            for c in range(3):
                own = list(range(10 * c, 10 * c + 10))
                local = plain(vs[own], d)
                for i in own:
                    heads.setdefault(own[0] + local[i - own[0]], []).append(i)
            keys = sorted(heads)
            merged = plain(np.stack([unit(u[heads[h]].mean(0)) for h in keys]), 0.15)
            for h, to in zip(keys, merged.values(), strict=True):
                replay |= dict.fromkeys(heads[h], keys[merged[keys.index(h)]] if to is not None else None)

            def majors(labels):
                out = []
                for c in set(labels.values()):
                    own = [i for i in labels if labels[i] == c]
                    sim = u[own] @ unit(u[own].mean(0))
                    if len(own) >= 3 and 4 * len(own) >= 5 and 10 * (max(own) - min(own)) + 4 >= 20 and round(float(np.median(sim)), 6) >= 0.3:
                        out.append(c)
                return out

            a, b = majors(whole), majors(replay)
            shared = [i for i in whole if whole[i] in a and replay[i] in b]
            n = sum(whole[i] in a for i in whole)
            r = got[m, d]
            assert (r.clusters, r.count_match) == (len(a), len(a) == len(b))
            assert abs(r.coverage - (len(shared) / n if n else 0)) < 1e-9 and abs(r.speech_ratio - n / 30) < 1e-9
            assert abs(r.ari - (rand_index({i: whole[i] for i in shared}, {i: replay[i] for i in shared}) if len(shared) > 1 else 0)) < 1e-9
            assert abs(r.all_ari - rand_index(whole, replay)) < 1e-9 and r.reverse_ari > 0.9


def one_fit(x, y, l2):
    """Newton steps of one logistic regression with balanced classes, on standardised features."""
    m, s = x.mean(0), x.std(0)
    z = np.c_[np.ones(len(x)), (x - m) / np.where(s > 0, s, 1)]
    w, weight = np.zeros(z.shape[1]), np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (1 - y).sum())
    ridge = np.r_[0, np.full(x.shape[1], l2)]
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + np.diag(ridge + 1e-12), z.T @ (weight * (p - y)) + ridge * w)
        w -= step
    return lambda q: 1 / (1 + np.exp(-(np.c_[np.ones(len(q)), (q - m) / np.where(s > 0, s, 1)] @ w)))


@pytest.mark.parametrize("folds", [3, 150])
def test_all_folds_at_once_are_one_fit_for_each(spark, folds):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 4)) * [1, 5, 0.1, 1] + [0, 3, 0, 0]
    x[:, 3] = 7  # no spread
    y = (x[:, 0] + x[:, 1] / 5 + 0.5 * rng.standard_normal(400) > 0.6).astype(int)
    g = rng.integers(0, folds, 400)
    frame = spark.createDataFrame([(i, f"g{g[i]}", x[i].tolist(), int(y[i])) for i in range(400)], "i long, g string, x array<double>, y int").repartition(5)
    got = {r.i: r for r in speakers.leave_one_out(frame, "g", "x", "y").collect()}
    assert len(got) == 400
    for fold in random.Random(1).sample(sorted(set(g)), 3):
        p = one_fit(x[g != fold], y[g != fold], 1.0)(x[g == fold])
        for i, q in zip(np.flatnonzero(g == fold), p, strict=True):
            assert got[i].predicted == int(q >= 0.5) and abs(got[i].confidence - max(q, 1 - q)) < 1e-6


def test_folds_without_two_classes(spark):
    frame = spark.createDataFrame([(0, "a", [1.0], 1), (1, "a", [2.0], 1), (2, "b", [3.0], 0), (3, "b", [4.0], 0), (4, None, [1.0], 1)], "i long, g string, x array<double>, y int")
    got = {r.i: (r.predicted, r.confidence) for r in speakers.leave_one_out(frame.filter("g is not null"), "g", "x", "y").collect()}
    assert got == {0: (0, 1.0), 1: (0, 1.0), 2: (1, 1.0), 3: (1, 1.0)}
    assert {r.i: (r.predicted, r.confidence) for r in speakers.leave_one_out(frame.filter("g = 'a'"), "g", "x", "y").collect()} == {0: (1, 1.0), 1: (1, 1.0)}
    assert speakers.leave_one_out(frame.filter("false"), "g", "x", "y").count() == 0
    assert speakers.leave_one_out(frame, "g", "x", "y").count() == 5


def test_queries_read_vectors(spark):
    chosen = registry.queries()["nearest_distance_pick"](spark, SF).collect()
    assert {r.meeting for r in chosen} == set(range(5)) and all(0.5 <= r.chosen <= 0.9 for r in chosen)
    replayed = registry.queries()["chunk_replay"](spark, SF).collect()
    assert all(-1 <= r.ari <= 1 and 0 <= r.coverage <= 1 for r in replayed)
    judged = registry.queries()["audio_judge"](spark, SF).collect()
    assert len(judged) == 500 and all(0.5 <= r.confidence <= 1 for r in judged)
    clusters = registry.queries()["agglomerative"](spark, SF).filter(F.col("meeting") == 0).collect()
    e = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id < 100").collect()}
    want = plain([e[i] for i in range(100)], 0.5)
    got = {r.vec_id: r.cluster for r in clusters}
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in got for j in got)


def test_long_vectors_at_unit_length(spark):
    """The length of a vector is taken once, not for each of its numbers."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=3000).tolist()) for i in range(40)] + [(90, [0.0, 0.0]), (91, None), (92, []), (93, [3.0, 4.0])]
    frame = spark.createDataFrame(rows, "i long, v array<float>")
    began = time.time()
    got = {r.i: r.u for r in frame.select("i", tx.unit("v").alias("u")).collect()}
    middle = {r.i: r.center for r in lk.centers(frame.filter("i < 40"), ["i"], "v").collect()}
    assert time.time() - began < 25
    for i, v in rows[:40]:
        x = np.asarray(v, np.float32).astype(float)
        assert np.allclose(got[i], x / np.sqrt(x @ x), atol=1e-12) and np.allclose(middle[i], got[i], atol=1e-12)
    assert got[90] == [0.0, 0.0] and got[91] is None and got[92] == [] and np.allclose(got[93], [0.6, 0.8])
