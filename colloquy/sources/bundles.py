"""Bundles of a session's outputs that can be verified later: hash trees, a sink that commits by its manifest, and the check of both.

A hash tree has the digest of each row, of each block of rows, of each file, and of the session: each is the SHA-256 of the
digests below it, in order. Two trees are compared by one full outer join. Bundles of all sessions are written by one job and
verified by one.

Layout of a root: `data/session=.../fingerprint=.../name=.../part-*.txt`, written first, and `manifest/run=.../`, written
last. A bundle whose writing stopped halfway has data and no manifest row, and is never verified.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "colloquy.bundle/1"
STATES = ("ready", "review_required", "no_speech", "blocked")
#: What a bundle holds, and what it is made from.
OUTPUTS = ("handoff_evidence", "meeting", "notes", "quality_verdict", "transcript")
INPUTS = ("clean_dialogue", "evidence_notes", "notes", "quality_verdict_json", "quality_verdict_md", "readiness", "review_items", "session", "speaker_selection", "transcript")
CHECKED = ("readiness", "quality_verdict_json", "evidence_notes", "clean_dialogue", "speaker_selection")
#: Rows whose digests are joined in one value.
BLOCK = 1000


def digest_of(values: Column) -> Column:
    """SHA-256 of the values, a line each."""
    return F.sha2(F.array_join(values, "\n"), 256)


def _above(level: DataFrame, keys: list[str], order: str, total: str = "n") -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("digest").alias("d"))))
    return level.groupBy(*keys).agg(digest_of(F.transform(ordered, lambda x: x["d"])).alias("digest"), F.sum(total).alias("n"))


def hash_tree(rows: DataFrame, key: list[str], file: str, place: str, value: Column, block: int = BLOCK) -> DataFrame:
    """key, level (row, block, file or bundle), file, block, place, digest and n (rows below) of rows ordered by place, a whole number, in each file.

    A block holds the rows of `block` consecutive places, a file its blocks, a bundle its files by name, so no value is put
    together from more than a block, or from a file's blocks. Rows of one place are told apart by their digests. A null value
    is hashed as the text null.
    """
    leaf = rows.select(*key, F.col(file).cast("string").alias("file"), F.floor(F.col(place) / block).cast("long").alias("block"), F.col(place).cast("long").alias("place"), F.sha2(F.coalesce(value, F.lit("null")), 256).alias("digest"), F.lit(1).cast("long").alias("n"))
    blocks = _above(leaf.withColumn("at", F.struct("place", "digest")), [*key, "file", "block"], "at")
    files = _above(blocks, [*key, "file"], "block")
    bundles = _above(files.withColumn("digest", F.concat_ws(":", "file", "digest")), key, "file")

    def level(frame: DataFrame, name: str) -> DataFrame:
        at = [F.col(c) if c in frame.columns else F.lit(None).cast(t).alias(c) for c, t in (("file", "string"), ("block", "long"), ("place", "long"))]
        return frame.select(*key, F.lit(name).alias("level"), *at, "digest", "n")

    return level(leaf, "row").unionByName(level(blocks, "block")).unionByName(level(files, "file")).unionByName(level(bundles, "bundle"))


def tree_diff(declared: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """key, level, file, block, place and reason (missing, unexpected or changed) of all nodes that two trees don't share; equal keys may be null.

    Rows of one place are compared as one, by all their digests.
    """
    at = [*key, "level", "file", "block", "place"]
    sides = [t.groupBy(*at).agg(F.array_join(F.array_sort(F.collect_list("digest")), ",").alias(n)) for t, n in ((declared, "_d"), (actual, "_a"))]
    left, right = (s.select(*[F.col(c).alias(f"{c}_{i}") for c in at], f"_{i}") for s, i in zip(sides, "da", strict=True))
    same = None
    for c in at:
        same = F.col(f"{c}_d").eqNullSafe(F.col(f"{c}_a")) if same is None else same & F.col(f"{c}_d").eqNullSafe(F.col(f"{c}_a"))
    both = left.join(right, same, "full_outer")
    reason = F.when(F.col("_a").isNull(), "missing").when(F.col("_d").isNull(), "unexpected").when(F.col("_a") != F.col("_d"), "changed")
    return both.select(*[F.coalesce(f"{c}_d", f"{c}_a").alias(c) for c in at], reason.alias("reason")).filter("reason is not null")


def input_blockers(inputs: DataFrame, sessions: DataFrame, expected: dict[str, str]) -> DataFrame:
    """session and blockers, in the order of INPUTS: an input that is missing, can't be read, or of another schema than expected (those of CHECKED).

    inputs are rows(session, name, present, error, schema); a session without a row for an input misses it.
    """
    wanted = sessions.select("session").distinct().select("session", F.posexplode(F.array(*map(F.lit, INPUTS))).alias("at", "name"))
    both = wanted.join(inputs.select("session", "name", "present", "error", "schema"), ["session", "name"], "left")
    schema = F.create_map(*[F.lit(x) for pair in expected.items() for x in pair]) if expected else F.create_map().cast("map<string,string>")
    reason = F.when(~F.coalesce("present", F.lit(False)), F.concat(F.lit("input_missing:"), "name")).when(F.col("error").isNotNull(), F.concat("name", F.lit(":"), "error"))
    reason = reason.when(F.col("name").isin(*CHECKED) & ~F.coalesce(F.col("schema") == F.try_element_at(schema, F.col("name")), F.lit(False)), F.concat("name", F.lit(":unsupported_schema")))
    return both.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.when(reason.isNotNull(), F.struct("at", reason.alias("r"))))), lambda x: x["r"]).alias("blockers"))


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), bytes and sha256 of every file, hashed where it is read; hidden and marker files don't count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", r"(session=.*)$", 1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _parts(files: DataFrame) -> DataFrame:
    """Files with the session, fingerprint and name that their path tells."""
    for c in ("session", "fingerprint", "name"):
        files = files.withColumn(c, F.url_decode(F.regexp_extract("path", f"{c}=([^/]*)/", 1)))
    return files


def write_bundles(outputs: DataFrame, inputs: DataFrame, sessions: DataFrame, root: str, run: str) -> None:
    """Writes the bundles of all sessions below root, and then the manifest of the run that binds them.

    outputs are rows(session, name, place, value), inputs rows(session, name, bytes, sha256), sessions rows(session, state,
    resolution); session is a string. The fingerprint of a bundle is the SHA-256 of its basis: schema, state, resolution, the
    digests of its outputs' trees and of its inputs. A fingerprint that has been written before is written again as the same
    files; rows of sessions that aren't in `sessions` are left out.
    """
    spark = outputs.sparkSession
    tree = hash_tree(outputs, ["session"], "name", "place", F.col("value")).filter("level = 'file'")
    made = tree.groupBy("session").agg(F.array_sort(F.collect_list(F.concat_ws(":", "file", "digest"))).alias("made"))
    used = inputs.groupBy("session").agg(F.array_sort(F.collect_list(F.concat_ws(":", "name", "sha256"))).alias("used"))
    head = sessions.join(made, "session", "left").join(used, "session", "left")
    basis = F.to_json(F.struct(F.lit(SCHEMA).alias("schema"), "session", "state", "resolution", F.coalesce("made", F.array()).alias("outputs"), F.coalesce("used", F.array()).alias("inputs")))
    head = head.select("session", "state", "resolution", basis.alias("basis")).withColumn("fingerprint", F.sha2("basis", 256))
    rows = outputs.join(head.select("session", "fingerprint"), "session")
    rows = rows.repartition("session", "name", F.floor(F.col("place") / (BLOCK * 100))).sortWithinPartitions("session", "name", "place")
    rows.select("session", "fingerprint", "name", "value").write.mode("append").partitionBy("session", "fingerprint", "name").text(f"{root}/data")
    nothing = {c: F.lit(None).cast(t) for c, t in (("name", "string"), ("path", "string"), ("bytes", "long"), ("sha256", "string"), ("state", "string"), ("resolution", "string"), ("basis", "string"), ("schema", "string"))}

    def manifest(frame: DataFrame, kind: str) -> DataFrame:
        return frame.select("session", "fingerprint", F.lit(kind).alias("kind"), *[F.col(c) if c in frame.columns else v.alias(c) for c, v in nothing.items()])

    bound = head.select("session", "fingerprint")
    parts = [manifest(head.withColumn("schema", F.lit(SCHEMA)), "bundle"), manifest(_parts(inventory(spark, f"{root}/data")).join(bound, ["session", "fingerprint"]), "output"), manifest(inputs.join(bound, "session"), "input")]
    parts[0].unionByName(parts[1]).unionByName(parts[2]).write.parquet(f"{root}/manifest/run={run}")


def verify_bundles(spark: SparkSession, root: str, run: str, inputs: DataFrame | None = None) -> DataFrame:
    """session, verified and reasons (in the order of the checks) of every bundle that has data or a row in the run's manifest.

    inputs are the current rows(session, name, bytes, sha256); None leaves the inputs unchecked.
    """
    shape = "session string, fingerprint string, kind string, name string, path string, bytes long, sha256 string, state string, resolution string, basis string, schema string"
    try:
        manifest = spark.read.schema(shape).parquet(f"{root}/manifest/run={run}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        manifest = spark.createDataFrame([], shape)
    actual = _parts(inventory(spark, f"{root}/data"))
    return check_bundles(manifest, actual, inputs)


def check_bundles(manifest: DataFrame, actual: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
    """The reasons of verify_bundles, from manifest rows, files(session, fingerprint, name, path, bytes, sha256) and current inputs(session, name, bytes, sha256)."""
    head, outputs, used = (manifest.filter(F.col("kind") == k) for k in ("bundle", "output", "input"))

    def reasons(frame: DataFrame, *found: tuple[int, Column, str]) -> DataFrame:
        named = frame if "name" in frame.columns else frame.withColumn("name", F.lit(None).cast("string"))
        each = [F.when(when, F.struct(F.lit(rank).alias("rank"), F.coalesce("name", F.lit("")).alias("of"), (F.concat(F.lit(text), "name") if text.endswith(":") else F.lit(text)).alias("text"))) for rank, when, text in found]
        return named.select("session", F.explode(F.array_compact(F.array(*each))).alias("x"))

    names = outputs.groupBy("session").agg(F.array_sort(F.collect_set("name")).alias("outputs"))
    given = used.groupBy("session").agg(F.array_sort(F.collect_set("name")).alias("inputs"), F.max(F.when(F.col("name") == "speaker_transcript", F.col("sha256"))).alias("spoken"), F.max(F.when(F.col("name") == "transcript", F.col("sha256"))).alias("whole"))
    stored = actual.groupBy("session", "fingerprint").agg(F.count("*").alias("files"))
    header = head.drop("name").join(names, "session", "left").join(given, "session", "left").join(stored, ["session", "fingerprint"], "left")
    allowed = F.array(*map(F.lit, (*INPUTS, "speaker_transcript")))
    wanted = F.when(F.col("resolution") == "selected", F.array_sort(allowed)).otherwise(F.array(*map(F.lit, INPUTS)))
    have = F.coalesce("inputs", F.array().cast("array<string>"))
    found = [
        reasons(
            header,
            (1, ~F.coalesce(F.col("schema") == SCHEMA, F.lit(False)), "unsupported_schema"),
            (2, ~F.coalesce(F.col("state").isin(*STATES), F.lit(False)), "invalid_state"),
            (3, F.col("basis").isNull() | F.col("fingerprint").isNull(), "fingerprint_missing"),
            (3, F.sha2("basis", 256) != F.col("fingerprint"), "fingerprint_mismatch"),
            (4, F.col("files").isNull(), "bundle_missing"),
            (5, ~F.coalesce(F.col("outputs") == F.array(*map(F.lit, OUTPUTS)), F.lit(False)), "bundle_files_incomplete"),
            (10, F.size(F.array_except(have, allowed)) > 0, "manifest_inputs_unexpected"),
            (11, (F.col("state") != "blocked") & (have != wanted), "manifest_inputs_incomplete"),
            (15, ~F.coalesce(F.col("resolution").isin("selected", "fallback"), F.lit(False)), "speaker_resolution_state_invalid"),
            (16, (F.col("resolution") == "selected") & F.col("spoken").isNull(), "speaker_resolved_transcript_missing"),
            (16, (F.col("resolution") == "fallback") & F.col("whole").isNull(), "aggregate_fallback_transcript_missing"),
        )
    ]
    bound = head.select("session", "fingerprint")
    now = actual.join(bound, ["session", "fingerprint"], "left_semi").select("session", F.col("name").alias("name_now"), "path", F.col("bytes").alias("bytes_now"), F.col("sha256").alias("sha_now"))
    both = outputs.select("session", "name", "path", "bytes", "sha256").join(now, ["session", "path"], "full_outer").withColumn("name", F.coalesce("name", "name_now"))
    found.append(reasons(both, (6, F.col("sha_now").isNull(), "missing_output:"), (7, F.col("bytes") != F.col("bytes_now"), "output_size_changed:"), (8, F.col("sha256") != F.col("sha_now"), "output_hash_changed:"), (9, F.col("sha256").isNull(), "unexpected_output:")))
    loose = actual.select("session").distinct().join(bound, "session", "left_anti")
    found.append(reasons(loose, (0, F.lit(True), "manifest_missing")))
    if inputs is not None:
        current = inputs.select("session", "name", F.col("bytes").alias("bytes_now"), F.col("sha256").alias("sha_now"))
        met = used.select("session", "name", "bytes", "sha256").join(current, ["session", "name"], "left")
        found.append(reasons(met, (12, F.col("sha_now").isNull(), "stale_input_missing:"), (13, F.col("bytes") != F.col("bytes_now"), "stale_input_size:"), (14, F.col("sha256") != F.col("sha_now"), "stale_input_hash:")))
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    sessions = bound.select("session").unionByName(loose).distinct()
    listed = every.distinct().groupBy("session").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]).alias("reasons"))
    out = sessions.join(listed, "session", "left")
    return out.select("session", F.col("reasons").isNull().alias("verified"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def handoff_matches(payloads: DataFrame, readiness: DataFrame, rows: DataFrame) -> DataFrame:
    """session, matches and reason: a handoff holds if the fingerprint of its transcript is that of the table's rows now, and the readiness row names the same profile and transcript.

    payloads are (session, sha256, n, profile, path), readiness (session, profile, path), rows (session, file, place, value).
    """
    now = hash_tree(rows, ["session"], "file", "place", F.col("value")).filter("level = 'bundle'").select("session", F.col("digest").alias("sha_now"), F.col("n").alias("n_now"))
    ready = readiness.select("session", F.col("profile").alias("profile_now"), F.col("path").alias("path_now"), F.lit(True).alias("known"))
    both = payloads.join(now, "session", "left").join(ready, "session", "left")
    same = {c: F.coalesce(F.col(a) == F.col(b), F.lit(False)) for c, a, b in (("size", "n", "n_now"), ("hash", "sha256", "sha_now"), ("profile", "profile", "profile_now"), ("path", "path", "path_now"))}
    reason = F.when(F.col("sha_now").isNull(), "transcript_missing").when(~same["size"], "transcript_size_changed").when(~same["hash"], "transcript_hash_changed")
    reason = reason.when(F.col("known").isNull(), "readiness_missing").when(~same["profile"], "readiness_profile_differs").when(~same["path"], "readiness_transcript_differs")
    return both.select("session", reason.isNull().alias("matches"), F.coalesce(reason, F.lit("match")).alias("reason"))

