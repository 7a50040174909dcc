"""Bundles on files: round trip, each way to fail, half-written ones; hash trees against plain hashing."""

import hashlib
import os
import random
from pathlib import Path

from pyspark.sql import functions as F

from colloquy.plans import bundle_queries
from colloquy.sources import bundles

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_tree_is_plain_hashing_and_differences_are_found(spark):
    rng = random.Random(1)
    rows = [(k, f"f{f}", i, rng.choice("abc")) for k in "xy" for f in range(3) for i in range(7)] + [(None, None, 1, None)]
    frame = spark.createDataFrame(rows, "k string, f string, place long, v string").repartition(4)
    tree = {(r.k, r.level, r.file, r.block, r.place): (r.digest, r.n) for r in bundles.hash_tree(frame, ["k"], "f", "place", F.col("v"), 3).collect()}
    for k in "xy":
        files = []
        for f in ("f0", "f1", "f2"):
            own = [sha(r[3]) for r in sorted(rows[:-1], key=lambda r: r[2]) if r[:2] == (k, f)]
            blocks = [sha("\n".join(own[i : i + 3])) for i in range(0, 7, 3)]
            assert tree[k, "file", f, None, None] == (sha("\n".join(blocks)), 7)
            files.append(f"{f}:{sha(chr(10).join(blocks))}")
        assert tree[k, "bundle", None, None, None] == (sha("\n".join(files)), 21)
    other = frame.filter("not (k = 'x' and f = 'f1' and place = 4)").withColumn("v", F.expr("case when k = 'y' and place = 0 then 'z' else v end"))
    other = other.unionByName(spark.createDataFrame([("x", "f9", 0, "n")], frame.schema))
    found = {(r.k, r.level, r.file, r.place, r.reason) for r in bundles.tree_diff(*(bundles.hash_tree(t, ["k"], "f", "place", F.col("v"), 3) for t in (frame, other)), ["k"]).collect()}
    assert {x for x in found if x[1] == "row"} == {("x", "row", "f1", 4, "missing"), ("x", "row", "f9", 0, "unexpected"), *(("y", "row", f"f{i}", 0, "changed") for i in range(3))}
    assert {x[:3] for x in found if x[1] == "bundle"} == {("x", "bundle", None), ("y", "bundle", None)}
    assert not bundles.tree_diff(*(bundles.hash_tree(frame.repartition(n), ["k"], "f", "place", F.col("v"), 3) for n in (1, 5)), ["k"]).count()


def made(spark):
    outputs = bundle_queries.bundle_outputs(spark, SF).withColumn("session", F.col("session").cast("string"))
    whole = outputs.groupBy("session").agg(F.count_if(F.col("name") == "notes").alias("n")).filter("n > 0")
    names = [r.session for r in whole.orderBy("session").limit(8).collect()]
    outputs = outputs.filter(F.col("session").isin(names))
    inputs = spark.createDataFrame([(s, n, 10, sha(f"{s} {n}")) for s in names for n in bundles.INPUTS], "session string, name string, bytes long, sha256 string")
    sessions = spark.createDataFrame([(s, "ready", "fallback") for s in names], "session string, state string, resolution string")
    return names, outputs, inputs, sessions


def reasons(spark, root, inputs=None, run="1"):
    return {r.session: r.reasons for r in bundles.verify_bundles(spark, root, run, inputs).collect()}


def test_round_trip_and_every_fault(spark, tmp_path):
    names, outputs, inputs, sessions = made(spark)
    root = str(tmp_path / "bundles")
    bundles.write_bundles(outputs, inputs, sessions, root, "1")
    assert reasons(spark, root, inputs) == {s: [] for s in names}
    assert all(r.verified for r in bundles.verify_bundles(spark, root, "1").collect())

    def part(session, name):
        return next(Path(root, "data", f"session={session}").glob(f"*/name={name}/part-*"))

    part(names[0], "notes").unlink()
    part(names[1], "meeting").write_text("other")
    file = part(names[2], "transcript")
    text = file.read_text()
    file.write_text(("b" if text[0] == "a" else "a") + text[1:])
    extra = part(names[3], "notes").parent
    (extra / "part-extra.txt").write_text("x")
    for crc in Path(root, "data").rglob("*.crc"):
        os.remove(crc)
    stale = inputs.filter(f"not (session = '{names[4]}' and name = 'notes')").withColumn("bytes", F.when((F.col("session") == names[5]) & (F.col("name") == "session"), 11).otherwise(F.col("bytes")))
    stale = stale.withColumn("sha256", F.when((F.col("session") == names[5]) & (F.col("name") == "readiness"), "0").otherwise(F.col("sha256")))
    got = reasons(spark, root, stale)
    assert got[names[0]] == ["missing_output:notes"]
    assert got[names[1]] == ["output_size_changed:meeting", "output_hash_changed:meeting"]
    assert got[names[2]] == ["output_hash_changed:transcript"]
    assert got[names[3]] == ["unexpected_output:notes"]
    assert got[names[4]] == ["stale_input_missing:notes"]
    assert got[names[5]] == ["stale_input_size:session", "stale_input_hash:readiness"]
    assert got[names[6]] == got[names[7]] == []


def test_half_written_bundles_are_never_verified(spark, tmp_path):
    names, outputs, inputs, sessions = made(spark)
    root = str(tmp_path / "bundles")
    bundles.write_bundles(outputs, inputs, sessions, root, "1")
    assert reasons(spark, root, run="2") == {s: ["manifest_missing"] for s in names}


def test_manifest_faults(spark):
    head = ("s", "f", "bundle", None, None, None, None, "odd", "selected", "{}", "other/1")
    rows = [head, ("s", "f", "output", "notes", "p", 3, "h", None, None, None, None), ("s", "f", "input", "surprise", None, 1, "h", None, None, None, None)]
    manifest = spark.createDataFrame(rows, "session string, fingerprint string, kind string, name string, path string, bytes long, sha256 string, state string, resolution string, basis string, schema string")
    actual = spark.createDataFrame([], "session string, fingerprint string, name string, path string, bytes long, sha256 string")
    got = bundles.check_bundles(manifest, actual).collect()[0]
    assert not got.verified and got.reasons == ["unsupported_schema", "invalid_state", "fingerprint_mismatch", "bundle_missing", "bundle_files_incomplete", "missing_output:notes", "manifest_inputs_unexpected", "manifest_inputs_incomplete", "speaker_resolved_transcript_missing"]


def test_blockers_of_each_input(spark):
    sessions = spark.createDataFrame([("a",), ("b",)], "session string")
    rows = [("a", n, True, None, "1") for n in bundles.INPUTS]
    rows[5] = ("a", "readiness", True, None, "2")
    rows[2] = ("a", "notes", True, "invalid_json", "1")
    rows[0] = ("a", "clean_dialogue", True, None, None)
    inputs = spark.createDataFrame(rows, "session string, name string, present boolean, error string, schema string")
    got = {r.session: r.blockers for r in bundles.input_blockers(inputs, sessions, dict.fromkeys(bundles.CHECKED, "1")).collect()}
    assert got["a"] == ["clean_dialogue:unsupported_schema", "notes:invalid_json", "readiness:unsupported_schema"]
    assert got["b"] == [f"input_missing:{n}" for n in bundles.INPUTS]


def test_handoffs_fail_in_three_ways(spark):
    rows = spark.createDataFrame([(s, "f", i, f"{s}{i}") for s in "abcd" for i in range(3)], "session string, file string, place long, value string")
    tree = {r.session: r for r in bundles.hash_tree(rows, ["session"], "file", "place", F.col("value")).filter("level = 'bundle'").collect()}
    payloads = spark.createDataFrame([(s, tree[s].digest if s != "b" else "0", 3, "p", "t") for s in "abcd"] + [("e", "0", 3, "p", "t")], "session string, sha256 string, n long, profile string, path string")
    readiness = spark.createDataFrame([("a", "p", "t"), ("b", "p", "t"), ("c", "q", "t"), ("d", "p", "u"), ("e", "p", "t")], "session string, profile string, path string")
    assert {r.session: r.reason for r in bundles.handoff_matches(payloads, readiness, rows).collect()} == {"a": "match", "b": "transcript_hash_changed", "c": "readiness_profile_differs", "d": "readiness_transcript_differs", "e": "transcript_missing"}
