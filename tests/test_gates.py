"""Every kind of condition, and measures of odd documents."""

from pyspark.sql import functions as F

from colloquy.operators import gates


def documents(spark, rows, kind="source string, sha256 string, j string"):
    return spark.createDataFrame(rows, kind).withColumn("doc", F.try_parse_json("j"))


def test_conditions(spark):
    docs = documents(spark, [("a", "ha", '{"d":"GO","g":{"x":true,"y":true},"h":{"x":true,"y":false},"e":{},"n":3.5,"l":[],"z":0,"s":"hb","f":false}'), ("b", "hb", '{"q":{"n":3.4996,"t":"GO"}}'), ("c", None, "{not json")])
    g = gates.rule
    cases = [
        (g("a", "in", "in", "$.d", "STOP", "GO"), True), (g("a", "in_not", "in", "$.d", "STOP"), False), (g("a", "in_missing", "in", "$.nothing", "GO"), False),
        (g("a", "is", "is", "$.g.x", "true"), True), (g("a", "is_false", "is", "$.f", "false"), True), (g("a", "is_not", "is", "$.h.y", "true"), False),
        (g("a", "number", "number", "$.n", "3.5"), True), (g("a", "number_off", "number", "$.n", "3"), False), (g("a", "number_near", "number", "$.n", "3", tolerance=0.5), True),
        (g("a", "every", "every", "$.g"), True), (g("a", "every_one_false", "every", "$.h"), False), (g("a", "every_none", "every", "$.e"), False), (g("a", "every_left_out", "every", "$.h", "y"), True),
        (g("a", "all_none", "all", "$.e"), True), (g("a", "all_missing", "all", "$.nothing"), True), (g("a", "all_false", "all", "$.h"), False), (g("a", "all_no_object", "all", "$.d"), False),
        (g("a", "empty_list", "empty", "$.l"), True), (g("a", "empty_zero", "empty", "$.z"), True), (g("a", "empty_not", "empty", "$.d"), False), (g("c", "empty_document", "empty", "$.d"), True), (g("none", "empty_source", "empty", "$.d"), True),
        (g("a", "same", "same", "$.n", other="b", other_path="$.q.n", tolerance=0.001), True), (g("a", "same_off", "same", "$.n", other="b", other_path="$.q.n"), False), (g("a", "same_text", "same", "$.d", other="b", other_path="$.q.t"), True), (g("a", "same_missing", "same", "$.n", other="c", other_path="$.n"), False),
        (g("a", "hash", "hash", "$.s", other="b"), True), (g("a", "hash_not", "hash", "$.s", other="a"), False),
    ]
    both = [g("a", "two", "is", "$.g.x", "true"), g("a", "two", "is", "$.h.y", "true")]
    got = {r.gate: r for r in gates.apply_gates(docs, gates.rules(spark, [c for c, _ in cases] + both)).collect()}
    assert {c[1]: got[c[1]].passed for c, _ in cases} == {c[1]: ok for c, ok in cases}
    assert not got["two"].passed and got["two"].observed == "true" and got["every"].observed == '{"x":true,"y":true}'
    assert "semantic_gate:a:two" in {r.failure for r in gates.failures(gates.apply_gates(docs, gates.rules(spark, both))).collect()}


def test_measures_of_odd_documents(spark):
    rows = [("k", 1, '{"pipeline_status":"complete","meeting_duration_sec":60,"verdict":"good","suggested_closure_auto_rows":2,"suggested_closure_auto_seconds":0.0004,"risk_flags":["a"],"remote_forbidden_gate_passed":true}'), ("k", 2, '{"meeting_duration_sec":"180","suggested_closure_auto_rows":"3","suggested_closure_auto_seconds":1.25,"suggested_closure_status":null,"risk_flags":[]}'), ("k", 3, None), (None, 4, "{}")]
    got = {(r.k, r.measure, r.item): r.value for r in gates.corpus_report(documents(spark, rows, "k string, i long, j string"), ["k"], "i").collect()}
    assert len({m for _, m, _ in got}) == len(gates.corpus_measures()) + 5
    assert got["k", "session_count", None] == 3 and got[None, "session_count", None] == 1
    assert (got["k", "complete_pipeline_count", None], got["k", "partial_or_incomplete_count", None]) == (1, 2)
    assert (got["k", "total_duration_sec", None], got["k", "total_duration_min", None], got["k", "median_duration_min", None]) == (240, 4, 2)
    assert got[None, "median_duration_min", None] is None and got[None, "total_duration_min", None] == 0
    assert (got["k", "suggested_closure_auto_rows", None], got["k", "suggested_closure_auto_seconds", None]) == (5, 1.25)
    assert got["k", "sessions_with_suggested_closure", None] == 0 and got["k", "sessions_with_risk_flags", None] == 1 and got["k", "top_risk_sessions", "1"] == 1
    assert got["k", "by_verdict", "missing"] == 2 and got["k", "by_verdict", "good"] == 1 and got["k", "remote_forbidden_gate_passed_sessions", None] == 1
