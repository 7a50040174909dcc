"""Every operator on nulls in any column, empty and very long texts, ties, repeated rows, clashing column names and empty tables."""

from collections import Counter

import pytest

from colloquy.llm import embeddings, fingerprints, jaccard, language_id, language_model, mixing, packing, quality, secrets, substrings

LONG = "lorem ipsum dolor sit amet " * 12_000
CLASH = "score double, label int, sig string, component string, key long, place int, tile long, batch long, _row long, _statistics string, tokens int, quota long, weight double, epoch int, n_tokens string, block int, row string, whole boolean"
EXTRA = (0.5, 7, "s", "c", 1, 2, 3, 4, 5, "t", 1, 2, 0.5, 3, "n", 4, "r", True)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"the {w} of small things and large ones {i} times", "en", "a", 50) for i, w in enumerate(["state", "price", "name", "sound"] * 5)]
    rows += [(100, None, "en", None, None), (101, "", None, "a", 0), (102, LONG, "en", "b", len(LONG)), (103, " \n\t ", "en", "b", 4), (3, rows[3][1], "en", "a", 50), (3, rows[3][1], "en", "a", 50), (3, "another text of that id", "en", "a", 23), (None, "no id here at all", "en", "a", 17), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], f"doc_id long, text string, lang string, source string, n_chars int, {CLASH}").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(3, 1, 0), (None, 1, 0), (5, None, None), (999, 0, 0)], "doc_id long, quality int, toxic int")


def by_row(docs, labels):
    return {
        "jaccard": lambda d: jaccard.near_duplicates(d),
        "fingerprints": lambda d: fingerprints.fingerprint_documents(d),
        "languages": lambda d: language_id.identify(d),
        "substrings": lambda d: substrings.digests(d),
        "quality": lambda d: quality.score_documents(d, labels),
        "secrets": lambda d: secrets.digests(d),
        "model": lambda d: language_model.score_documents(d),
    }


@pytest.mark.parametrize("name", ["jaccard", "fingerprints", "languages", "substrings", "quality", "secrets", "model"])
def test_each_row_has_its_result(docs, labels, name):
    run = by_row(docs, labels)[name]
    want = Counter(r.doc_id for r in docs.select("doc_id").collect())
    out = run(docs).collect()
    assert Counter(r.doc_id for r in out) == want
    assert run(docs.filter("false")).count() == 0


def test_repeated_rows_have_equal_results(docs, labels):
    for name in ("quality", "secrets", "model", "languages"):
        rows = Counter(tuple(map(str, r)) for r in by_row(docs, labels)[name](docs.filter("doc_id = 3 and text like 'the%'")).collect())
        assert len(rows) == 1 and sum(rows.values()) == 3, name


def test_packing_and_mixing(docs):
    pieces = packing.pack_documents(docs, 2048, "byte_bpe_50k", encode_special_tokens=False).collect()
    first = Counter(r.doc_id for r in pieces if r.piece == 0)
    assert first == Counter(r.doc_id for r in docs.select("doc_id").collect())
    places = Counter((r.sequence_id, r.offset + k) for r in pieces for k in range(r.length))
    assert max(places.values()) == 1 and max(p for _, p in places) < 2048
    mixed = mixing.repeat_small_sources(docs, 1.5)
    assert mixed.columns == docs.columns and mixed.count() >= docs.count()
    dealt = mixing.mix_documents(docs, 0.9)
    assert dealt.columns == ["doc_id", "source", "n_tokens", "epoch", "place"] and dealt.count() > 0
    assert {r.source for r in dealt.collect()} <= {"a", "b", None} and mixing.mix_documents(docs.filter("false")).count() == 0


def test_stages_keep_columns(docs, labels):
    assert quality.keep_good(docs, labels, 0.0).columns == docs.columns
    hidden = secrets.redact_documents(docs)
    assert hidden.columns == docs.columns and hidden.count() == docs.count()
    left = jaccard.drop_copies(docs)
    assert left.columns == docs.columns and Counter(r.doc_id for r in left.select("doc_id").collect())[3] == 2


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], "a", 1), (1, [1.0, 0.0], "a", 1), (None, [1.0, 0.0], "a", 1), (2, [], "a", 1), (3, None, None, None), (4, [1e300, 1.0], "a", 1), (5, [1e300, 1.0], "a", 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, node int")).collect()
    assert Counter(r.vec_id for r in got) == Counter(r[0] for r in rows)
    assert {r.vec_id: r.n_links for r in got}[4] == 4
