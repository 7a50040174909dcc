import re
from itertools import combinations

import numpy as np
import pytest

from colloquy.llm import jaccard
from colloquy.llm.graph import components
from colloquy.llm.jaccard import Bitmaps, bitmap_size, bitmaps, most_shared, near_duplicates


def brute(texts, percent=75, width=5):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    group = {i: i for i in texts}
    for a, b in combinations(texts, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((group[a], group[b]))
            group = {i: x if g == y else g for i, g in group.items()}
    return {i: (len(sets[i]), group[i]) for i in texts}


def near_texts(seed, n):
    """Texts of few words, many copies with edits near the threshold."""
    rng = np.random.default_rng(seed)
    base = [[f"w{x}" for x in rng.integers(0, 40 if seed % 2 else 4000, int(rng.integers(1, 120)))] for _ in range(8)]
    out = {}
    for i in range(n):
        words = list(base[int(rng.integers(8))])
        for _ in range(int(rng.integers(0, 6))):
            words[int(rng.integers(len(words)))] = f"e{rng.integers(10**6)}"
        out[i + 10] = " ".join(words[: max(1, len(words) - int(rng.integers(0, 12)))]).upper() if i % 7 == 0 else " \t".join(words)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_are_those_of_all_pairs(spark, seed):
    texts = near_texts(seed, 120) | {1: None, 2: "", 3: " \n", 4: "One two", 5: "one TWO", 6: "É é", 7: "long " * 9000}
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in texts.items()], "doc_id long, text string, component_id long, sig string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()} == brute(texts)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows(spark):
    rows = near_duplicates(spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.component_id) for r in sorted(rows)] == [(1, 1), (1, 1), (2, 1)]


def test_bit_counts_never_understate_the_overlap():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 44, int(rng.integers(1, 9000)))).astype(np.uint64) for _ in range(20)]
    sets += [np.unique(np.concatenate([x[: len(x) * 3 // 4], sets[0][:40]])) for x in sets]
    n = np.array([len(x) for x in sets])
    data, at = bitmaps(np.concatenate(sets), np.repeat(np.arange(len(sets)), n), bitmap_size(n))
    held = Bitmaps([data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
    i, j = map(np.array, zip(*combinations(range(len(sets)), 2), strict=True))
    most = most_shared(n[i], n[j], held.differing(i, j))
    assert all(m >= len(np.intersect1d(sets[a], sets[b])) for a, b, m in zip(i, j, most, strict=True))


def test_blocks_of_hot_shingles_and_classes_lose_no_link(spark, monkeypatch):
    for name, value in (("WAVES", (1, 1)), ("BLOCK", 4), ("ARRAYS_TOGETHER", 300), ("SMALL_TILE", 3)):
        monkeypatch.setattr(jaccard, name, value)
    texts = near_texts(3, 100)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()} == brute(texts)


def test_components_of_paths_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, **{i: 200 for i in range(200, 203)}}
