import json

from pyspark.sql import functions as F

from colloquy.sources import session_files
from colloquy.streaming import live


def segments(n=6):
    return [{"session": "s", "source": src, "index": i, "start": 5.0 * i, "end": 5.0 * i + 5, "text": f"words of {i // 2}", "closed": not (i == 5 and src == "remote"), "t": f"2024-01-01T00:00:{i:02d}Z"} for i in range(n) for src in ("mic", "remote")]


def stream(spark, tmp_path, query, name):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(map(json.dumps, segments())))
    frame = query(spark.readStream.schema(live.SEGMENTS).json(str(source)))
    q = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_pairs_need_both_closed(spark, tmp_path):
    rows = stream(spark, tmp_path, live.paired, "pairs")
    assert sorted(r["index"] for r in rows) == [0, 1, 2, 3, 4]


def test_repeats_of_the_last_kept_go(spark, tmp_path):
    rows = stream(spark, tmp_path, lambda s: live.without_repeats(s.filter("source = 'mic'")), "kept")
    assert {r["index"]: r["kept"] for r in rows} == {0: True, 1: False, 2: True, 3: False, 4: True, 5: False}


def test_provisional(spark):
    rows = live.provisional(spark.createDataFrame(segments()).filter("source = 'mic'"), 7.0).select("index", "provisional").collect()
    assert {r["index"] for r in rows if r["provisional"]} == {4, 5}


def test_json_lines_drop_what_is_no_object(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n\n[1]\n{"a": \n"x"\n{"a": 2}\n')
    assert sorted(r.a for r in session_files.json_lines(spark, str(path), "a int").collect()) == [1, 2]
    assert session_files.json_lines(spark, str(tmp_path / "none"), "a int").count() == 0


def test_tab_transcript(spark, tmp_path):
    (tmp_path / "t.txt").write_text("0:00:01\tA\thi\nnoise\n0:01:00\tB\tyo\n")
    rows = session_files.tab_transcript(spark, str(tmp_path / "t.txt")).orderBy("start").collect()
    assert [(r.start, r.end, r.speaker) for r in rows] == [(1.0, 60.0, "A"), (60.0, 90.0, "B")]


def test_markdown(spark):
    turns = spark.createDataFrame([("s", 61, "A", "hi"), ("s", 0, "B", "yo")], "session string, start int, speaker string, text string")
    row = session_files.markdown_transcript(turns, "session", "start", "speaker", "text").filter(F.col("session") == "s").first()
    assert row.markdown == "- [00:00:00] **B**: yo\n- [00:01:01] **A**: hi"


def plain_lag(batches, most):
    """Lag of each segment behind the latest end seen so far in its session."""
    captured, out = {}, {}
    for batch in batches:
        for r in sorted(batch, key=lambda r: (r["t"], r["index"])):
            captured[r["session"]] = max(captured.get(r["session"], 0.0), r["end"])
            lag = captured[r["session"]] - r["end"]
            out[r["session"], r["index"]] = (lag <= most or most <= 0, round(lag, 3))
    return out


def test_lag_budget_over_restarts_and_late_rows(spark, tmp_path):
    """Each run of the query ends and starts anew from its checkpoint; a segment far behind the watermark is left out, the state of a silent session ends."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = tmp_path / "in"
    source.mkdir()

    def row(session, index, end, minute):
        return {"session": session, "source": "mic", "index": index, "start": end - 5, "end": end, "text": "x", "closed": True, "t": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z"}

    batches = [
        [row("a", 0, 100.0, 0), row("a", 1, 40.0, 1), row("b", 0, 10.0, 1)],
        [row("a", 2, 75.0, 3), row("a", 3, 130.0, 4), row("b", 1, 9.0, 5)],
        [row("c", 0, 5.0, 600)],
        [row("a", 9, 1.0, 2), row("a", 4, 20.0, 601), row("c", 1, 2.0, 602)],
    ]
    for k, batch in enumerate(batches):
        (source / f"{k}.json").write_text("\n".join(map(json.dumps, batch)))
        frame = live.lag_decisions(spark.readStream.schema(live.SEGMENTS).json(str(source)), 30.0, "10 minutes", 240)
        q = frame.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(180)
    got = {(r.session, r["index"]): (r.run, r.observed_live_lag_sec) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = plain_lag(batches[:2], 30.0)
    assert {k: got[k] for k in want} == want and not got["a", 1][0]
    assert ("a", 9) not in got  # ten minutes behind the watermark
    assert got["a", 4] == (True, 0.0)  # the state of before has been cleared
    assert got["c", 1] == (True, 3.0)
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert {r.reason for r in rows.collect()} == {"within_lag_budget", "live_lag_budget_exceeded"}
