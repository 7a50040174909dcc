"""Queries of bundles, hash trees and incremental refresh, over the live turns of conversations and their batch transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import incremental as inc
from colloquy.plans.registry import register
from colloquy.plans.views import LIVE_SQL, batch_turns, live_turns
from colloquy.sources import bundles

W = f"WITH {LIVE_SQL}"
_VALUE = "role || ' ' || array_to_string(tokens, ' ')"




def _value() -> F.Column:
    return F.concat_ws(" ", "role", F.array_join("tokens", " "))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    live = live_turns(spark, sf_dir).select("session", "chunk", F.col("id").alias("place"), _value().alias("value"))
    return live, batch_turns(spark, sf_dir).select("session", "chunk", (F.col("id") - 1000).alias("place"), _value().alias("value"))


_BOTH = f"""{W}, l AS (SELECT session, chunk AS file, id AS place, id // 1000 AS block, sha256({_VALUE}) AS digest FROM live), b AS (SELECT session, chunk AS file, id - 1000 AS place, (id - 1000) // 1000 AS block, sha256({_VALUE}) AS digest FROM batch),
lb AS (SELECT session, file, block, sha256(string_agg(digest, chr(10) ORDER BY place)) AS digest, count(*) AS n FROM l GROUP BY ALL), bb AS (SELECT session, file, block, sha256(string_agg(digest, chr(10) ORDER BY place)) AS digest, count(*) AS n FROM b GROUP BY ALL),
lf AS (SELECT session, file, sha256(string_agg(digest, chr(10) ORDER BY block)) AS digest, sum(n) AS n FROM lb GROUP BY ALL), bf AS (SELECT session, file, sha256(string_agg(digest, chr(10) ORDER BY block)) AS digest, sum(n) AS n FROM bb GROUP BY ALL),
ls AS (SELECT session, sha256(string_agg(file || ':' || digest, chr(10) ORDER BY CAST(file AS VARCHAR))) AS digest, sum(n) AS n FROM lf GROUP BY ALL), bs AS (SELECT session, sha256(string_agg(file || ':' || digest, chr(10) ORDER BY CAST(file AS VARCHAR))) AS digest, sum(n) AS n FROM bf GROUP BY ALL)"""
_DIFF = "SELECT coalesce(x.session, y.session) AS session, '{level}' AS level, {file} AS file, {block} AS block, {place} AS place, CASE WHEN y.digest IS NULL THEN 'missing' WHEN x.digest IS NULL THEN 'unexpected' ELSE 'changed' END AS reason FROM {a} x FULL JOIN {b} y USING ({on}) WHERE x.digest IS DISTINCT FROM y.digest"
_FILE, _BLOCK, _PLACE = "CAST(coalesce(x.file, y.file) AS VARCHAR)", "coalesce(x.block, y.block)", "coalesce(x.place, y.place)"


@register("verify_manifest", f"""{_BOTH} {_DIFF.format(level='row', file=_FILE, block=_BLOCK, place=_PLACE, a='l', b='b', on='session, file, block, place')} UNION ALL {_DIFF.format(level='block', file=_FILE, block=_BLOCK, place='NULL', a='lb', b='bb', on='session, file, block')}
 UNION ALL {_DIFF.format(level='file', file=_FILE, block='NULL', place='NULL', a='lf', b='bf', on='session, file')} UNION ALL {_DIFF.format(level='bundle', file='NULL', block='NULL', place='NULL', a='ls', b='bs', on='session')}""")
def verify_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, blocks, files and sessions in which the batch transcript isn't the live one."""
    live, batch = (bundles.hash_tree(side, ["session"], "chunk", "place", F.col("value")) for side in _sides(spark, sf_dir))
    return bundles.tree_diff(live, batch, ["session"])


_OUT = f"""{W}, o AS (SELECT session, 'transcript' AS name, id AS place, {_VALUE} AS v FROM live UNION ALL SELECT session, 'notes', id, {_VALUE} FROM live WHERE content >= 5 UNION ALL SELECT session, 'handoff_evidence', id, sha256({_VALUE}) FROM live
 UNION ALL SELECT session, 'meeting', 0, 'turns ' || count(*) || ' end ' || max(e) FROM live GROUP BY session UNION ALL SELECT session, 'quality_verdict', row_number() OVER (PARTITION BY session ORDER BY role) - 1, role || ' ' || count(*) || ' ' || sum(len(tokens)) FROM live GROUP BY session, role),
k AS (SELECT session, name, place // 1000 AS block, sha256(string_agg(sha256(v), chr(10) ORDER BY place)) AS digest, count(*) AS n FROM o GROUP BY ALL), f AS (SELECT session, name, sha256(string_agg(digest, chr(10) ORDER BY block)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY ALL),
c AS (SELECT session, count(*) FILTER (suspicious) AS doubtful FROM batch GROUP BY session), t AS (SELECT session, count(*) FILTER (name = 'notes') AS notes, sha256(string_agg(name || ':' || digest, chr(10) ORDER BY name)) AS fingerprint FROM f GROUP BY session)"""


@register("evidence_bundle_sink", f"""{_OUT} SELECT session, name, n, digest, fingerprint, CASE WHEN notes = 0 THEN ['input_missing:notes'] ELSE [] END AS blockers, CASE WHEN notes = 0 THEN 'blocked' WHEN coalesce(doubtful, 0) > 0 THEN 'review_required' ELSE 'ready' END AS state FROM f JOIN t USING (session) LEFT JOIN c USING (session)""")
def evidence_bundle_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of every session's bundle with their digests, the bundle's fingerprint, what blocks it, and its state. The sink writes the same rows to files (tests/test_bundles.py)."""
    outputs = bundle_outputs(spark, sf_dir)
    tree = bundles.hash_tree(outputs, ["session"], "name", "place", F.col("value"))
    files = tree.filter("level = 'file'").select("session", F.col("file").alias("name"), "n", "digest")
    whole = tree.filter("level = 'bundle'").select("session", F.col("digest").alias("fingerprint"))
    sessions = files.select("session").distinct()
    there = sessions.crossJoin(spark.createDataFrame([(n,) for n in bundles.INPUTS if n != "notes"], "name string")).select("session", "name")
    there = there.unionByName(files.filter("name = 'notes'").select("session", "name")).withColumn("present", F.lit(True)).withColumn("error", F.lit(None).cast("string")).withColumn("schema", F.lit("1"))
    blocked = bundles.input_blockers(there, sessions, dict.fromkeys(bundles.CHECKED, "1"))
    doubtful = batch_turns(spark, sf_dir).groupBy("session").agg(F.count_if("suspicious").alias("doubtful"))
    out = files.join(whole, "session").join(blocked, "session").join(doubtful, "session", "left")
    state = F.when(F.size("blockers") > 0, "blocked").when(F.coalesce("doubtful", F.lit(0)) > 0, "review_required").otherwise("ready")
    return out.select("session", "name", "n", "digest", "fingerprint", "blockers", state.alias("state"))


def bundle_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, name, place, value: the five outputs of each conversation."""
    live = live_turns(spark, sf_dir).withColumn("value", _value())
    rows = live.select("session", F.lit("transcript").alias("name"), F.col("id").alias("place"), "value")
    notes = live.filter("content >= 5").select("session", F.lit("notes").alias("name"), F.col("id").alias("place"), "value")
    proof = live.select("session", F.lit("handoff_evidence").alias("name"), F.col("id").alias("place"), F.sha2("value", 256).alias("value"))
    meeting = live.groupBy("session").agg(F.concat_ws(" ", F.lit("turns"), F.count("*").cast("string"), F.lit("end"), F.max("end").cast("string")).alias("value")).select("session", F.lit("meeting").alias("name"), F.lit(0).cast("long").alias("place"), "value")
    roles = live.groupBy("session", "role").agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("w"))
    listed = roles.groupBy("session").agg(F.array_sort(F.collect_list(F.concat_ws(" ", "role", F.col("n").cast("string"), F.col("w").cast("string")))).alias("v"))  # a line for each role
    verdict = listed.select("session", F.posexplode("v").alias("place", "value")).select("session", F.lit("quality_verdict").alias("name"), F.col("place").cast("long").alias("place"), "value")
    return rows.unionByName(notes).unionByName(proof).unionByName(meeting).unionByName(verdict)


@register("handoff_verify", f"""{_BOTH}, p AS (SELECT ls.session, ls.digest, ls.n, mode_role AS profile, 'chunks/' || chunks AS path FROM ls JOIN (SELECT session, min(role) AS mode_role, count(DISTINCT chunk) AS chunks FROM live GROUP BY session) USING (session)), r AS (SELECT session, min(role) AS profile, 'chunks/' || count(DISTINCT chunk) AS path FROM batch WHERE NOT suspicious GROUP BY session)
SELECT session, reason = 'match' AS matches, reason FROM (SELECT p.session, CASE WHEN bs.digest IS NULL THEN 'transcript_missing' WHEN bs.n <> p.n THEN 'transcript_size_changed' WHEN bs.digest <> p.digest THEN 'transcript_hash_changed' WHEN r.session IS NULL THEN 'readiness_missing' WHEN r.profile <> p.profile THEN 'readiness_profile_differs' WHEN r.path <> p.path THEN 'readiness_transcript_differs' ELSE 'match' END AS reason
 FROM p LEFT JOIN bs USING (session) LEFT JOIN r USING (session))""")
def handoff_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handoffs made of the live transcript, held against the batch one and its profile."""
    live, batch = _sides(spark, sf_dir)
    tree = bundles.hash_tree(live, ["session"], "chunk", "place", F.col("value")).filter("level = 'bundle'").select("session", F.col("digest").alias("sha256"), "n")

    def named(rows: DataFrame) -> DataFrame:
        return rows.groupBy("session").agg(F.min("role").alias("profile"), F.concat(F.lit("chunks/"), F.countDistinct("chunk").cast("string")).alias("path"))

    payloads = tree.join(named(live_turns(spark, sf_dir)), "session")
    return bundles.handoff_matches(payloads, named(batch_turns(spark, sf_dir).filter("not suspicious")), batch.withColumnRenamed("chunk", "file"))


PARAMETERS = {"language": "en", "pad_ms": 500}
_IDENTITY = """{n}c AS (SELECT session, chunk, string_agg({value}, chr(10) ORDER BY id) AS content FROM {table} GROUP BY ALL), {n}d AS (SELECT *, sha256(chunk || ':' || content) AS d FROM {n}c),
{n}s AS (SELECT *, coalesce(sum(CAST('0x' || substr(d, 1, 12) AS BIGINT)) OVER w, 0) || '-' || coalesce(sum(CAST('0x' || substr(d, 13, 12) AS BIGINT)) OVER w, 0) AS context FROM {n}d WINDOW w AS (PARTITION BY session ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{n}i AS (SELECT session, chunk, content, context, '{{"schema":"colloquy.identity/1","key":' || session || ',"index":' || chunk || ',"content":"' || sha256(content) || '","context":"' || context || '","parameters":"{{\\"language\\":\\"en\\",\\"pad_ms\\":500}}"}}' AS identity FROM {n}s)"""


def _chunks(rows: DataFrame) -> DataFrame:
    """session, chunk and content of chunks of six turns at most."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", _value().alias("v")))), lambda x: x["v"]), "\n")
    return rows.groupBy("session", "chunk").agg(text.alias("content"))


@register("cache_identity", f"{W}, {_IDENTITY.format(n='l', value=_VALUE, table='live')} SELECT session, chunk, context, sha256(identity) AS identity_sha256 FROM li")
def cache_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inc.identities(_chunks(live_turns(spark, sf_dir)), "session", "chunk", "content", PARAMETERS)
    return out.select("session", "chunk", "context", "identity_sha256")


@register("cache_validate", f"""{W}, {_IDENTITY.format(n='l', value=_VALUE, table='live')}, {_IDENTITY.format(n='b', value=_VALUE, table='batch')}, x AS (SELECT session, chunk, count(*) FILTER (suspicious) = 0 AS completed FROM batch GROUP BY ALL)
SELECT session, chunk, reason = 'exact_identity_and_integrity_match' AS hit, reason FROM (SELECT li.session, li.chunk, CASE WHEN bi.session IS NULL THEN 'metadata_missing_or_invalid' WHEN NOT completed THEN 'cache_entry_schema_or_completion_mismatch' WHEN li.identity <> bi.identity THEN 'canonical_identity_mismatch' WHEN li.content <> bi.content THEN 'canonical_input_hash_mismatch' WHEN length(bi.content) % 5 = 0 THEN 'output_hash_mismatch' ELSE 'exact_identity_and_integrity_match' END AS reason
 FROM li LEFT JOIN bi USING (session, chunk) LEFT JOIN x USING (session, chunk))""")
def cache_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the live transcript held against entries made of the batch one; those of a length that five divides have another output than noted."""
    batch = batch_turns(spark, sf_dir)
    expected = inc.identities(_chunks(live_turns(spark, sf_dir)), "session", "chunk", "content", PARAMETERS).select("session", "chunk", "identity_sha256", F.sha2("content", 256).alias("input_sha256"))
    kept = inc.identities(_chunks(batch), "session", "chunk", "content", PARAMETERS).join(batch.groupBy("session", "chunk").agg((F.count_if("suspicious") == 0).alias("completed")), ["session", "chunk"])
    output = F.sha2(F.upper("content"), 256)
    stored = kept.select("session", "chunk", F.lit(inc.ENTRY).alias("schema"), "completed", "identity", F.col("identity_sha256").alias("stored_sha256"), F.sha2("content", 256).alias("input_now"), F.lit(True).alias("input_readable"), output.alias("output_sha256"), F.when(F.length("content") % 5 == 0, F.sha2("content", 256)).otherwise(output).alias("output_now"), F.lit(True).alias("payload_valid"))
    return inc.validate(expected, stored, ["session", "chunk"]).select("session", "chunk", "hit", "reason")
