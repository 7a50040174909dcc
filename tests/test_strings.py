"""String functions on hand-written values: Unicode forms, spans in code points, empty and null texts."""

import random
import time

from pyspark.sql import functions as F

from colloquy.functions import strings as st
from colloquy.functions import text as tx


def test_compatibility_forms(spark):
    rows = [("Ёлка ﬁn Ⅷ", "елка fin viii"), ("don’t re-do_it", "don’t re-do it"), ("  ", ""), ("", ""), (None, None), ("Straße①", "strasse1"), ("é é", "é é")]
    got = spark.createDataFrame(rows, "t string, want string").select(st.normalize_nfkc("t").alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_spans_count_code_points(spark):
    rows = [("Hi, wi-fi 3/4!", [("hi", 0, 2), ("wi-fi", 4, 9), ("3/4", 10, 13)]), ("😀 Ok", [("ok", 2, 4)]), ("", []), (None, []), ("a+b -c", [("a+b", 0, 3), ("c", 5, 6)])]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    for r in frame.select("i", st.display_token_spans("t").alias("s")).collect():
        assert [(x.token, x.start, x.end) for x in r.s] == rows[r.i][1]


def test_elements_are_multisets(spark):
    rows = [(["a", "b", "a"], ["a", "a", "c"], 2), ([], ["a"], 0), (["x"] * 5, ["x"] * 3, 3), (["a", "b"], ["b", "a"], 2)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>, want int").select(tx.shared_count(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_shared_work_is_done_once(spark):
    """Trigrams, repeats and likeness of long texts: what a lambda uses isn't computed for each item."""
    long = " ".join(f"w{i * 7919 % 3001}" for i in range(3000))
    rows = spark.createDataFrame([(0, long, long[:9000]), (1, "Ab c", "abcd"), (2, "", "x"), (3, None, "x"), (4, "ab", "AB"), (5, "ё😀😀ё", "ё")], "i int, x string, y string")
    began = time.time()
    got = {r.i: r for r in rows.select("i", tx.char_ngrams(F.col("x")).alias("g"), tx.jaccard(tx.char_ngrams(F.col("x")), tx.char_ngrams(F.col("y"))).alias("j"), st.adjacent_repeat(F.split("x", " ")).alias("r")).collect()}
    assert time.time() - began < 15
    bare = long.replace(" ", "")
    grams = list(dict.fromkeys(bare[i : i + 3] for i in range(len(bare) - 2)))
    part = long[:9000].replace(" ", "")
    other = {part[i : i + 3] for i in range(len(part) - 2)}
    assert got[0].g == grams and abs(got[0].j - len(set(grams) & other) / len(set(grams) | other)) < 1e-12 and got[0].r is None
    assert [got[i].g for i in (1, 2, 4, 5)] == [["abc"], [], ["ab"], ["ёё"]] and got[2].j == 0.0 and got[4].j == 1.0


def test_adjacent_repeats(spark):
    rng = random.Random(3)
    lists = [[rng.choice("abc") for _ in range(rng.randrange(40))] for _ in range(300)] + [[None, "a", "b", None, "a", "b"], None, ["x"] * 50]

    def plain(a):
        return next(((i, k) for k in range(16, 2, -1) for i in range(len(a) - 2 * k + 1) if a[i : i + k] == a[i + k : i + 2 * k]), None) if a is not None else None

    got = {r.i: r.r for r in spark.createDataFrame(list(enumerate(lists)), "i int, a array<string>").select("i", st.adjacent_repeat(F.col("a")).alias("r")).collect()}
    assert {i: tuple(r) if r else None for i, r in got.items()} == {i: plain(a) for i, a in enumerate(lists)}
