import json

from pyspark.sql import functions as F

from colloquy.sources import session_files as sf
from colloquy.streaming import live


def seg(text, a, b, p=0.9):
    return {"text": text, "offsets": {"from": a, "to": b}, "tokens": [{"text": "[_BEG_]", "p": 1.0, "offsets": {"from": a, "to": a}}, *[{"text": f" {w}", "p": p, "offsets": {"from": a + 10 * i, "to": a + 10 * i + 10}} for i, w in enumerate(text.split())]]}


def test_segments_say_why_they_are_dropped(spark, tmp_path):
    rows = [seg("hello there you", 0, 900), seg("", 900, 1000), seg("x", 5, 5), seg("Subtitles by Me", 1000, 2000), seg("so", 2000, 6000, 0.3), seg("hello there you", 0, 900), seg("bye", 7000, 7500), seg("Bye!", 30000, 30500), seg("bye", 95000, 95500)]
    (tmp_path / "a.json").write_text(json.dumps({"transcription": rows}))
    out = sf.speech_segments(spark, str(tmp_path / "a.json"), "remote", goodbyes=["bye"]).orderBy("index").collect()
    assert [r.reason for r in out] == [None, "empty", "zero_duration", "known_hallucination", "low_confidence_short_remote", "exact_duplicate_segment", None, "repeated_goodbye_hallucination", None]
    assert [t.text for t in out[0].tokens] == [" hello", " there", " you"]
    words = sf.words(sf.speech_segments(spark, str(tmp_path / "a.json"), "mic")).filter("index = 0").orderBy("place").collect()
    assert [(w.word, w.start, w.end) for w in words] == [("hello", 0, 10), ("there", 10, 20), ("you", 20, 30)]


def test_dialogue_bounds_roles_and_ids(spark, tmp_path):
    u = [{"text": " hi ", "start": 2.0, "role": "mic"}, {"text": ""}, {"id": "x", "text": "yo", "source_start": 5.0, "end": 4.0, "speaker_label": "colleague", "quality": {"needs_review": True}}, {"text": "z", "role": "Anna"}]
    (tmp_path / "d.json").write_text(json.dumps({"utterances": u}))
    rows = sf.dialogue(spark, str(tmp_path / "d.json")).orderBy("id").drop("file").collect()
    assert [tuple(r) for r in rows] == [("batch_000000", 2.0, 2.0, "Me", "hi", False), ("batch_000003", 0.0, 0.0, "Anna", "z", False), ("x", 5.0, 5.0, "Colleagues", "yo", True)]


def test_states_and_missing_files(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"start": 0, "end": 1.5, "action": "local_only"}\n{"start": 2}\nnonsense\n')
    assert [tuple(r) for r in sf.speaker_states(spark, str(tmp_path / "s.jsonl")).collect()] == [(0.0, 1.5, "local_only")]
    assert sf.speaker_states(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_range_transcripts(spark, tmp_path):
    (tmp_path / "t.txt").write_text("noise\n0:10 - 0:20\n\nAnna\nhello\nagain\n---\n1:00:00 - 0:59:00\nBob\n\n0:30 - 0:40\n")
    rows = sf.range_transcript(spark, str(tmp_path / "t.txt")).orderBy("start").collect()
    assert [(r.start, r.end, r.speaker, r.text) for r in rows] == [(10.0, 20.0, "Anna", "hello again ---"), (30.0, 40.0, "", ""), (3600.0, 3600.01, "Bob", "")]
    rows = sf.range_transcript(spark, str(tmp_path / "t.txt"), blocks=True).collect()
    assert [(r.speaker, r.text) for r in rows] == [("Anna", "hello again")]


def test_sessions_media_and_rttm(spark, tmp_path):
    for name in ("a", "_b", "c"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "session.json").write_text("{}")
    (tmp_path / "a" / "x.WAV").write_bytes(b"123")
    (tmp_path / "a" / "y.txt").write_text("no")
    assert {r.session for r in sf.sessions(spark, str(tmp_path)).collect()} == {"a", "c"}
    assert [(r.bytes, r.suffix) for r in sf.media_inventory(spark, str(tmp_path)).collect()] == [(3, "wav")]
    (tmp_path / "r.rttm").write_text("SPEAKER s 1 0.50 1.25 <NA> <NA> spk1 <NA>\nLEXEME x\n")
    assert [(r.session, r.speaker, r.start, r.end) for r in sf.rttm(spark, str(tmp_path / "r.rttm")).collect()] == [("s", "spk1", 0.5, 1.75)]


def test_policies_need_fresh_evidence(spark):
    e = {"a": ("p1", "h1"), "b": ("p2", "old"), "c": ("p9", "h9")}
    policies = spark.createDataFrame([("x", True, "promoted", e), ("y", False, "draft", {})], "id string, schema_ok boolean, state string, evidence map<string, struct<path: string, sha256: string>>")
    files = spark.createDataFrame([("p1", "h1"), ("p2", "new")], "path string, sha256 string")
    got = {r.id: r.reasons for r in sf.policy_reasons(policies, files).collect()}
    assert got == {"x": ["policy_evidence_stale:b", "policy_evidence_missing:c"], "y": ["selector_policy_schema_invalid", "selector_policy_not_promoted"]}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s", 2, 1.23456, [1]), ("s", 1, 2.0, None)], "session string, n int, x double, l array<int>")
    sf.write_json_lines(rows, str(tmp_path / "j"), "session", ["n"])
    lines = [json.loads(x) for f in (tmp_path / "j" / "session=s").glob("*.json") for x in f.read_text().splitlines()]
    assert [x["x"] for x in lines] == [2.0, 1.235]
    sf.write_csv(rows, str(tmp_path / "c"))
    assert sorted(r.l or "" for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()) == ["", "[1]"]
    notes = sf.obsidian_notes(spark.createDataFrame([("s", "v1", "good", None, "t")], "session string, profile string, verdict string, use_gate string, generated string"), spark.createDataFrame([("s", "- hi")], "session string, markdown string"))
    assert notes.first().note.startswith("---\nsession: s\nprofile: v1\nverdict: good\nuse_gate: null")


def test_speech_sessions_and_drafts(spark, tmp_path):
    events = spark.createDataFrame([("u", 0, 10), ("u", 15, 5), ("u", 100, 5)], "u string, at int, seconds int").withColumn("t", F.timestamp_seconds(F.col("at") + 1_700_000_000))
    rows = live.speech_sessions(events, "u", 8).orderBy("start").collect()
    assert [r.n for r in rows] == [2, 1]
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps({"session": "s", "source": "mic", "index": i, "start": 5.0 * i, "end": 5.0 * i + 5, "text": str(i), "closed": True, "t": f"2024-01-01T00:00:0{i}Z"}) for i in range(4)))
    q = live.write_draft(spark.readStream.schema(live.SEGMENTS).json(str(source)), str(tmp_path / "draft"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    rows = live.draft(spark, str(tmp_path / "draft"), 7.0).collect()
    assert {r["index"] for r in rows if r.provisional} == {2, 3} and len(rows) == 4
