"""Refresh by identity: what is computed again, and what an entry fails by."""

from pyspark.sql import functions as F

from colloquy.operators import incremental as inc

P = {"language": "en"}


def chunks(spark, change=None):
    rows = [(s, i, f"{s} {i}") for s in "abc" for i in range(5)] + [(None, 0, "x"), ("a", None, None)]
    rows = [(s, i, "changed" if (s, i) == change else t) for s, i, t in rows]
    return spark.createDataFrame(rows, "s string, i long, text string").repartition(3)


def test_only_changed_chunks_and_those_after_them_are_computed(spark, tmp_path):
    store, computed = str(tmp_path / "store"), []

    def compute(rows):
        computed.extend((r.s, r.i) for r in rows.collect())
        return rows.select("identity_sha256", F.upper(F.coalesce("text", F.lit(""))).alias("payload"))

    def run(frame, parameters=P):
        computed.clear()
        out = {(r.s, r.i): r.payload for r in inc.refresh(frame, "s", "i", "text", parameters, store, compute).collect()}
        assert out == {(r.s, r.i): (r.text or "").upper() for r in frame.collect()}
        return sorted(computed, key=str)

    assert len(run(chunks(spark))) == 17
    assert run(chunks(spark)) == []
    assert run(chunks(spark, ("b", 2))) == [("b", 2), ("b", 3), ("b", 4)]
    assert run(chunks(spark)) == []  # the first results are still there
    assert run(chunks(spark).filter("not (s <=> 'c' and i = 4)")) == []
    assert len(run(chunks(spark), {"language": "pl"})) == 17
    assert run(chunks(spark).filter("false")) == []


def test_spoilt_results_are_computed_again(spark, tmp_path):
    store = str(tmp_path / "store")
    inc.refresh(chunks(spark), "s", "i", "text", P, store, lambda r: r.select("identity_sha256", F.col("i").cast("string").alias("payload")))
    kept = inc.entries(spark, store)
    rows = [r.asDict() for r in kept.collect()]
    rows[0]["payload"] = "spoilt"
    rows[1]["completed"] = False
    spark.createDataFrame(rows, kept.schema).write.parquet(str(tmp_path / "other"))
    wanted = inc.identities(chunks(spark), "s", "i", "text", P)
    assert inc.missing(wanted, inc.entries(spark, str(tmp_path / "other"))).count() == 2
    assert inc.missing(wanted, inc.entries(spark, str(tmp_path / "none"))).count() == 17


def test_identities_don_t_depend_on_groups_of_chunks(spark, monkeypatch):
    want = {(r.s, r.i): r.identity_sha256 for r in inc.identities(chunks(spark), "s", "i", "text", P).collect()}
    monkeypatch.setattr(inc, "CHUNKS_TOGETHER", 2)
    assert {(r.s, r.i): r.identity_sha256 for r in inc.identities(chunks(spark), "s", "i", "text", P).collect()} == want and len(set(want.values())) == 17


def test_every_reason(spark):
    ids = inc.identities(spark.createDataFrame([(k, 0, "t") for k in range(12)], "k long, i long, text string"), "k", "i", "text", P)
    expected = ids.select("k", "identity_sha256", F.lit("in").alias("input_sha256"))
    rows = {r.k: [inc.ENTRY, True, r.identity, r.identity_sha256, "in", True, "out", "out", True] for r in ids.collect()}
    del rows[0]
    for k, place, value in ((1, 1, False), (2, 2, None), (3, 3, "0"), (5, 4, None), (6, 5, False), (7, 4, "other"), (8, 7, None), (9, 7, "other"), (10, 8, False)):
        rows[k][place] = value
    rows[4][2:4] = rows[3][2], None
    rows[4][3] = ids.filter("k = 3").first().identity_sha256
    stored = spark.createDataFrame([(k, *r) for k, r in rows.items()], "k long, schema string, completed boolean, identity string, stored_sha256 string, input_now string, input_readable boolean, output_sha256 string, output_now string, payload_valid boolean")
    got = {r.k: r.reason for r in inc.validate(expected, stored, ["k"]).collect()}
    assert [got[k] for k in range(12)] == ["metadata_missing_or_invalid", "cache_entry_schema_or_completion_mismatch", "identity_missing", "stored_identity_hash_mismatch", "canonical_identity_mismatch", "canonical_input_missing", "canonical_input_invalid", "canonical_input_hash_mismatch", "output_missing", "output_hash_mismatch", "output_payload_invalid", "exact_identity_and_integrity_match"]
