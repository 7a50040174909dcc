import importlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import mixing, quality


def prose(rng, n):
    return " ".join("".join(rng.choice(["the", "er", "on", "an", "ti", "nd"], int(rng.integers(1, 4)))) for _ in range(n)).capitalize() + "."


def junk(rng, n):
    return " ".join("".join(rng.choice(["THE", "ER", "ON"], 2)) + "!!" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(1)
    rows = [(i, junk(rng, int(rng.integers(5, 80))) if i % 4 == 0 else prose(rng, int(rng.integers(5, 80))), "en", "big" if i % 3 else f"s{i % 2}", 0) for i in range(300)]
    rows += [(1000, None, None, None, None), (1001, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(300) if i % 5] + [(1001, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_quality_is_told(corpus):
    docs, labels = corpus
    rows = quality.score_documents(docs, labels).collect()
    assert len(rows) == 302 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    known = [r for r in rows if r.held_out and r.doc_id < 1000]
    assert sum(r.predicted == (0 if r.doc_id % 4 == 0 else 1) for r in known) >= 0.95 * len(known) > 0


def test_without_labels_all_scores_are_equal(corpus):
    docs, labels = corpus
    rows = quality.score_documents(docs, labels.filter("false")).collect()
    assert len({r.score for r in rows}) == 1


def test_compiled_rules_are_the_rules(spark):
    rules = [((0, True, 0.5),), ((0, False, 0.2), (1, True, 3.0))]
    model = quality.RuleEnsemble(rules, [1.5, -2.0], 0.25)
    points = [[0.1, 2.0], [0.4, 2.0], [0.9, 9.0], [0.5, 3.0]]
    frame = spark.createDataFrame([(p,) for p in points], "x array<double>")
    got = [r.p for r in frame.select(model.probability(F.col("x")).alias("p")).collect()]
    want = [1 / (1 + math.exp(-(0.25 + 1.5 * (a <= 0.5) - 2.0 * (a > 0.2 and b <= 3)))) for a, b in points]
    assert np.allclose(sorted(got), sorted(want))


def test_entropy_and_budget_are_met(spark):
    rng = np.random.default_rng(2)
    rows = [(i, ["a"] * 8 + ["b"] * 3 + ["c", None], int(rng.integers(0, 50))) for i in range(2000)]
    rows = [(i, s[i % 13], n) for i, s, n in rows] + [(5000, "empty", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    total = sum(r[2] for r in rows)
    weights = {r.source: r for r in mixing.source_weights(docs, target_entropy=0.9, budget=total).collect()}
    w = [r.weight for r in weights.values() if r.weight]
    assert math.isclose(sum(w), 1, rel_tol=1e-9) and math.isclose(-sum(x * math.log(x) for x in w), 0.9 * math.log(4), rel_tol=1e-6)
    mixed = mixing.mix(docs, target_entropy=0.9, budget=total, block_tokens=500).collect()
    spent, seen = Counter(), defaultdict(Counter)
    for r in mixed:
        spent[r.source] += r.n_tokens
        seen[r.source][r.doc_id, r.epoch] += 1
    own = Counter(r[1] for r in rows)
    for s, r in weights.items():
        assert spent[s] <= r.quota and (not r.tokens or spent[s] > r.quota - 50)
        assert all(n == 1 for n in seen[s].values())
        for e in range(r.quota // r.tokens if r.tokens else 0):
            assert sum(k[1] == e for k in seen[s]) == own[s]
    assert all(0 <= r.place < 1 for r in mixed) and weights["empty"].weight == 0


def test_repetition_keeps_every_row_and_its_limit(corpus):
    docs, _ = corpus
    docs = docs.withColumn("epoch", F.lit("own"))
    out = mixing.repeat_small_sources(docs, repetition=1.5)
    assert out.columns == docs.columns
    times = Counter(r.doc_id for r in out.collect())
    assert set(times) == {r.doc_id for r in docs.collect()} and max(times.values()) == 2
    assert sum(times.values()) <= 1.5 * 302


def test_empty_tables(spark, corpus):
    docs, labels = corpus
    none = docs.filter("false")
    assert quality.score_documents(none, labels).count() == 0
    assert mixing.mix_documents(none).count() == 0
    assert mixing.repeat_small_sources(none, 1.5).count() == 0


def test_stages_keep_clean_documents_and_place_every_token(spark, corpus, tmp_path):
    docs, labels = corpus
    copy = docs.filter("doc_id = 1").withColumn("doc_id", F.lit(2001).cast("long"))
    docs.unionByName(copy).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    pipeline = importlib.import_module("corpus_pipeline")
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = at.columns
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(str(tmp_path / f"{i}-{name}"))
        at = spark.read.parquet(str(tmp_path / f"{i}-{name}"))
        ids = {r.doc_id for r in at.select("doc_id").collect()}
        clean = {i for i in range(300) if i % 4}
        assert clean <= ids and not {i for i in range(300) if i % 4 == 0} & ids
        assert (2001 in ids) == (i == 0)
        if i < 4:
            assert at.columns == columns
    places = sorted((r.sequence_id, r.offset, r.length) for r in at.collect())
    ends = {}
    for s, o, n in places:
        assert o == ends.get(s, 0)
        ends[s] = o + n
    assert max(ends.values()) <= 2048


def test_pipeline_runs_over_odd_rows_and_none(spark, corpus, tmp_path):
    docs, labels = corpus
    pipeline = importlib.import_module("corpus_pipeline")
    good = docs.filter("doc_id = 1").first()
    other = docs.filter("doc_id = 2").first()
    odd = [(1, good.text), (None, good.text), (None, other.text + " and a tail of its own"), (7001, None), (7002, ""), (3, " ".join(reversed(docs.filter("doc_id = 3").first().text.split())))]
    rows = [tuple((dict(doc_id=i, text=t)[c] if c in ("doc_id", "text") else good[c]) for c in docs.columns) for i, t in odd]
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = pipeline.run(spark, str(tmp_path)).collect()
    whole = Counter(r.doc_id for r in out if r.piece == 0)
    assert {i for i in range(300) if i % 4} <= set(whole) and None not in whole
    kept = pipeline.drop_near_copies(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()
    ids = Counter(r.doc_id for r in kept)
    assert ids[1] == 1 and ids[None] == 0 and ids[3] == 2 and ids[7001] == ids[7002] == 1
    none = tmp_path / "none"
    docs.filter("false").write.parquet(str(none / "documents.parquet"))
    labels.filter("false").write.parquet(str(none / "labels.parquet"))
    assert pipeline.run(spark, str(none)).count() == 0
