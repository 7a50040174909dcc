"""Operators that SQL doesn't check, and edge cases of those that it does, against plain Python."""

import random
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from colloquy.functions import strings as st
from colloquy.operators import evaluation as ev
from colloquy.operators import folds
from colloquy.operators import intervals as iv
from colloquy.operators import matching as mt


def rows_of(seed, n=120):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(3)}", i, (a := rng.randrange(0, 2000)), a + rng.randrange(0, 150)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, id long, start long, end long")


def test_islands_are_the_same_in_buckets_of_any_width(spark):
    rows = rows_of(1)
    want = {}
    for k in {r[0] for r in rows}:
        reach, island = None, -1
        for _, i, a, b in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[3], r[1])):
            if reach is None or a > reach + 5:
                island += 1
            reach = b if reach is None else max(reach, b)
            want[i] = island
    for width in (50, 700, 10_000):
        got = iv.islands(frame(spark, rows), ["k"], 5, order=("id",), width=width).collect()
        first = {k: min(r.island for r in got if r.k == k) for k in {r.k for r in got}}
        assert {r.id: r.island - first[r.k] for r in got} == want and set(first.values()) == {0}


def test_neighbours_across_buckets(spark):
    rows = rows_of(2)
    got = iv.lagged(frame(spark, rows), ["k"], ["start", "id"], {"before": "end"}, {"after": "start"}, width=64).collect()
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1]))
        for j, r in enumerate(own):
            g = next(x for x in got if x.id == r[1])
            assert (g.before, g.after) == (own[j - 1][3] if j else None, own[j + 1][2] if j + 1 < len(own) else None)


def test_nearest_with_ties_and_without_partners(spark):
    rows = rows_of(3)
    left, right = rows[:50], rows[50:]
    got = {r.id: r.near for r in iv.nearest(frame(spark, left), frame(spark, right), ["k"], "start", "id", width=97).collect()}
    for k, i, a, _ in left:
        best = min(((abs(a - r[2]), r[2], r[1]) for r in right if r[0] == k), default=None)
        assert (got[i].id if got[i] else None) == (best[2] if best else None)
    assert iv.nearest(frame(spark, left), frame(spark, right).filter("false"), ["k"], "start", "id").filter("near is null").count() == 50


def test_outer_overlap_joins_keep_equal_rows(spark):
    left = frame(spark, [("a", 1, 0, 10), ("a", 1, 0, 10), ("a", 2, 50, 60), ("b", 3, 0, 5)])
    right = frame(spark, [("a", 9, 5, 20)])
    assert sorted((r.l.id, r.r.id if r.r else None) for r in iv.overlap_join(left, right, ["k"], 7, "left").collect()) == [(1, 9), (1, 9), (2, None), (3, None)]
    assert sorted(r.id for r in iv.overlap_join(left, right, ["k"], 7, "left_anti").collect()) == [2, 3]
    assert iv.overlap_join(left.filter("false"), right, ["k"], 7).count() == 0


def test_differences_of_intervals(spark):
    rows = rows_of(4, 60)
    a, b = rows[:30], rows[30:]
    got = Counter()
    for r in iv.difference(frame(spark, a), frame(spark, b), ["k"]).collect():
        got.update((r.k, t) for t in range(r.start, r.end))
    cover = lambda side: {(k, t) for k, _, s, e in side for t in range(s, e)}
    assert set(got) == cover(a) - cover(b) and set(got.values()) <= {1}


def test_percentiles_count_equal_values(spark):
    rng = random.Random(5)
    values = [(k, rng.choice([1.0, 2.0, 2.0, 9.5, rng.random()])) for k in "ab" for _ in range(50)] + [("c", 3.0), ("d", None)]
    got = {r.k: (r.p, r.q) for r in ev.percentiles(spark.createDataFrame(values, "k string, v double"), ["k"], "v", {"p": 0.5, "q": 0.9}).collect()}

    def at(k, q):
        own = sorted(v for j, v in values if j == k)
        place = (len(own) - 1) * q
        low = own[int(place)]
        return low + (own[min(int(place) + 1, len(own) - 1)] - low) * (place - int(place))

    assert set(got) == {"a", "b", "c"} and all(abs(got[k][0] - at(k, 0.5)) < 1e-9 and abs(got[k][1] - at(k, 0.9)) < 1e-9 for k in got)


def test_ratios_edits_and_subsequences(spark):
    rng = random.Random(6)
    words = ["a", "b", "c", "d"]
    pairs = [([rng.choice(words) for _ in range(rng.randrange(7))], [rng.choice(words) for _ in range(rng.randrange(7))]) for _ in range(60)]
    rows = spark.createDataFrame([(i, a, b, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>, x string, y string")
    out = {r.i: r for r in rows.select("i", st.sequence_ratio("x", "y").alias("ratio"), st.word_edits("a", "b").alias("e"), st.lcs_length("a", "b").alias("lcs"), st.text_similarity(F.col("x"), F.col("y")).alias("sim")).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1))
        return row[-1]

    def lcs(a, b):
        return 0 if not a or not b else lcs(a[1:], b[1:]) + 1 if a[0] == b[0] else max(lcs(a[1:], b), lcs(a, b[1:]))

    for i, (a, b) in enumerate(pairs):
        x, y, r = " ".join(a), " ".join(b), out[i]
        ratio = SequenceMatcher(None, x, y).ratio() if x and y else 0.0
        assert abs(r.ratio - ratio) < 1e-12 and r.lcs == lcs(a, b) and r.sim >= ratio
        assert sum(r.e) == distance(a, b) and len(a) - r.e.deletions + r.e.insertions == len(b)


def turns(spark, rows):
    return spark.createDataFrame([("s", i, role, a, b, text.split(), len(set(text.split())), text) for i, role, a, b, text in rows], "session string, id long, role string, start long, end long, tokens array<string>, content int, text string")


def test_bounded_merges_stop_at_their_caps(spark):
    rows = turns(spark, [(1, "Me", 0, 100, "a b"), (2, "Me", 500, 900, "c"), (3, "Me", 1600, 1700, "d"), (4, "Me", 1700, 17000, "e"), (5, "Me", 17100, 17200, "f" * 219)])
    got = folds.bounded_merge(rows, ["session", "role"]).orderBy("start").collect()
    assert [(r.first_id, r.n, r.start, r.end, r.text) for r in got] == [(1, 2, 0, 900, "a b c"), (3, 1, 1600, 1700, "d"), (4, 1, 1700, 17000, "e"), (5, 1, 17100, 17200, "f" * 219)] or [(r.first_id, r.n) for r in got] == [(1, 2), (3, 1), (4, 1), (5, 1)]
    scored = rows.withColumn("confidence", F.col("id") / 10)
    got = folds.utterance_merge(scored, ["session", "role"]).orderBy("start").collect()
    assert got[0].n == 2 and abs(got[0].confidence - 0.15) < 1e-9
    assert folds.bounded_merge(rows.filter("false"), ["session"]).count() == 0


def test_duplicates_of_kept_rows_go(spark):
    rows = turns(spark, [(1, "Me", 0, 100, "a b c"), (2, "Me", 10, 110, "a b c d"), (3, "Me", 200, 300, "x y z"), (4, "Me", 205, 290, "q r s")])
    assert [r.id for r in folds.interval_dedupe(rows, ["session", "role"]).orderBy("id").collect()] == [2, 3, 4]
    said = turns(spark, [(1, "A", 0, 100, "one two three four"), (2, "A", 90, 200, "two three four five"), (3, "A", 150, 400, "two three four five"), (4, "B", 500, 600, "x")]).withColumnRenamed("role", "speaker")
    got = folds.adjacent_dedupe(said, ["session"]).orderBy("place").collect()
    assert [(r.place, r.id, r.text) for r in got] == [(1, 1, "one"), (2, 3, "two three four five"), (3, 4, "x")]
    gate = {r.id: r.kept for r in folds.boundary_gate(turns(spark, [(1, "A", 0, 1, "a b c d e"), (2, "A", 1, 2, "a b c d"), (3, "A", 2, 3, "x y"), (4, "A", 3, 4, "x y z w v u")]), ["session"]).collect()}
    assert gate == {1: True, 2: False, 3: True, 4: True}


def test_topics_words_context_and_samples(spark):
    rows = spark.createDataFrame([("s", i, 60.0 * i + (100 if i > 4 else 0), 60.0 * i + (100 if i > 4 else 0) + 50, i == 3, i * 4, "a" if i else "b") for i in range(9)], "session string, id long, start double, end double, marker boolean, salience int, role string")
    got = folds.topic_blocks(rows, ["session"]).orderBy("block").collect()
    assert [(r.block, r.n) for r in got] == [(1, 5), (2, 4)] and got[1].top == [5, 6, 7, 8]
    context = spark.createDataFrame([("c", 1, 0.0, 1.0, "expensive_candidate"), ("c", 2, 1.2, 2.0, "unresolved"), ("c", 3, 3.0, 4.0, "unresolved")], "k string, id long, start double, end double, route string")
    assert {r.id: (r.route, r.seed_id) for r in folds.causal_context(context, ["k"]).collect()} == {1: ("expensive_candidate", None), 2: ("expensive_candidate", 1), 3: ("unresolved", None)}
    u = spark.createDataFrame([("s", 0, 100, ["a", "b", "a"])], "session string, start long, end long, tokens array<string>")
    w = spark.createDataFrame([("s", 12.0, "a"), ("s", 80.0, "a")], "session string, at double, word string")
    assert [(r.place, r.start) for r in folds.word_alignment(u, w, ["session"]).orderBy("place").collect()] == [(0, 12.0), (1, 50.0), (2, 80.0)]
    some = spark.createDataFrame([("s", i, float(i), f"{i * 7 % 10}", i == 6) for i in range(10)], "session string, id long, at double, salt string, domain boolean")
    ids = [r.id for r in folds.spread_sample(some, ["session"], 3).collect()]
    assert 6 in ids and len(set(ids)) == 3


def test_best_remote_alignment_and_anchors(spark):
    a = turns(spark, [(1, "Me", 1000, 3000, "the blue lake is deep"), (2, "Me", 90000, 91000, "alone here")])
    b = turns(spark, [(11, "Colleagues", 1500, 3500, "the blue lake is deep now"), (12, "Colleagues", 2900, 4000, "other words entirely"), (13, "Colleagues", 300000, 301000, "alone here")])
    got = {r.id: r for r in mt.best_remote(a, b, ["lake"]).collect()}
    assert got[1].remote_id == 11 and got[1].time_overlap == 0.75 and got[1].term_overlap == 1.0 and got[2].distance_sec == 999.0 and got[2].remote_id is None
    lined = {r.id: r for r in mt.align(a, b).collect()}
    assert lined[1].matched and lined[1].turn_id == 11 and not lined[2].matched
    found = {r.id: (r.local_id, r.offset) for r in mt.anchors(a, b, least_words=2, least_score=0.5).collect()}
    assert found == {1: (11, 500.0), 2: (13, 210000.0)}
    assert mt.best_match(a, b.filter("false")).count() == 0
