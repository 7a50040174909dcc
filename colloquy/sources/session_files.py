"""Readers of session folders: JSON lines, transcripts as text, media inventories. Paths are any that Spark reads."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions import text as tx


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of a JSON-lines file or folder; blank, malformed and non-object lines are dropped, a path that isn't there has no rows."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    try:
        lines = spark.read.text(path).filter(F.trim("value").startswith("{"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kind)
    parsed = lines.select(F.from_json("value", T.StructType([*kind.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.filter("r is not null and r._bad is null").select("r.*").drop("_bad")


def tab_transcript(spark: SparkSession, path: str) -> DataFrame:
    """file, start, end, speaker, text of lines h:mm:ss<tab>speaker<tab>text: a row ends where the next starts, the last after 30 s, none before .01 s."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\t").alias("p")).filter((F.size("p") == 3) & F.col("p")[0].rlike(r"^\d+:\d\d:\d\d$"))
    clock = F.split(F.col("p")[0], ":")
    rows = lines.select("file", (clock[0].cast("double") * 3600 + clock[1].cast("double") * 60 + clock[2].cast("double")).alias("start"), F.col("p")[1].alias("speaker"), F.col("p")[2].alias("text"))
    after = F.lead("start").over(Window.partitionBy("file").orderBy("start", "speaker", "text"))
    return rows.select("file", "start", F.greatest(F.coalesce(after, F.col("start") + 30), F.col("start") + 0.01).alias("end"), "speaker", "text")


def rttm(spark: SparkSession, path: str) -> DataFrame:
    """file, session, speaker, start, end of SPEAKER lines."""
    p = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), p.alias("p")).filter((F.size("p") >= 8) & (F.col("p")[0] == "SPEAKER"))
    start = F.col("p")[3].cast("double")
    return lines.select("file", F.col("p")[1].alias("session"), F.col("p")[7].alias("speaker"), start.alias("start"), (start + F.col("p")[4].cast("double")).alias("end"))


def media_inventory(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("wav", "caf", "m4a", "mp3")) -> DataFrame:
    """path, bytes, suffix of media files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("bytes"))
    return files.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).filter(F.col("suffix").isin(*suffixes))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; nested columns as JSON."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    rows.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in rows.schema]).write.mode("overwrite").option("header", True).csv(path)


def markdown_transcript(turns: DataFrame, session: str, start: str, speaker: str, text: str) -> DataFrame:
    """session, markdown: a line for each turn in order."""
    line = F.format_string("- [%s] **%s**: %s", F.date_format(F.timestamp_seconds(F.col(start)), "HH:mm:ss"), F.col(speaker), F.col(text))
    rows = turns.groupBy(session).agg(F.sort_array(F.collect_list(F.struct(F.col(start).alias("s"), line.alias("l")))).alias("r"))
    return rows.select(session, F.array_join(F.transform("r", lambda r: r["l"]), "\n").alias("markdown"))


TOKEN = "array<struct<text:string,p:double,offsets:struct<`from`:bigint,`to`:bigint>>>"
RECOGNISED = f"transcription array<struct<text:string,offsets:struct<`from`:bigint,`to`:bigint>,tokens:{TOKEN}>>"
DIALOGUE = "utterances array<struct<id:string,text:string,start:double,end:double,source_start:double,source_end:double,speaker_label:string,role:string,quality:struct<needs_review:boolean>>>"


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file and the fields of one JSON document a file; a file that is no such document has nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.col("_metadata.file_path"))


def word_tokens(tokens: Column) -> Column:
    """(text, p, start, end) of the tokens that look like words; marks such as [_BEG_] go."""
    kept = F.filter(tokens, lambda t: ~F.startswith(t["text"], F.lit("[_")) & t["text"].rlike(r"[\p{L}\p{N}]"))
    return F.transform(kept, lambda t: F.struct(t["text"].alias("text"), t["p"].alias("p"), F.coalesce(t["offsets"]["from"], F.lit(0)).alias("start"), F.coalesce(t["offsets"]["to"], t["offsets"]["from"], F.lit(0)).alias("end")))


def speech_segments(spark: SparkSession, path: str, track: str, hallucination: str = "(?i)subtitles by", goodbyes: list[str] | None = None) -> DataFrame:
    """file, index, start, end, text, tokens, reason of a recogniser's segments: reason tells why one is dropped, and is null for those that stay.

    In this order: empty, zero_duration, known_hallucination, low_confidence_short_remote, exact_duplicate_segment (a kept one
    has the same bounds and text), repeated_goodbye_hallucination (a kept one with its text began at most a minute before).
    """
    rows = json_documents(spark, path, RECOGNISED).select("file", F.posexplode("transcription").alias("index", "r"))
    rows = rows.select("file", "index", F.coalesce("r.offsets.from", F.lit(0)).alias("start"), F.coalesce("r.offsets.to", F.lit(0)).alias("end"), tx.clean(F.coalesce("r.text", F.lit(""))).alias("text"), word_tokens(F.col("r.tokens")).alias("tokens"))
    n = F.size(F.filter("tokens", lambda t: t["p"].isNotNull()))
    mean = F.when(n > 0, F.aggregate("tokens", F.lit(0.0), lambda s, t: s + F.coalesce(t["p"], F.lit(0.0))) / n)
    low = F.when(n > 0, F.size(F.filter("tokens", lambda t: t["p"] < 0.5)) / n)
    noise = tx.probable_noise(F.col("text"), F.col("end") - F.col("start"), mean, low) if track == "remote" else F.lit(False)
    reason = F.when(F.col("text") == "", "empty").when(F.col("end") <= F.col("start"), "zero_duration").when(F.col("text").rlike(hallucination), "known_hallucination").when(noise, "low_confidence_short_remote")
    rows = rows.withColumn("reason", reason)
    ends = set(goodbyes or [])

    def named(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("index")
        seen, last, out = set(), {}, []
        for start, end, norm, why in frame[["start", "end", "norm", "reason"]].itertuples(index=False):
            if not isinstance(why, str):
                why = None
                if (start, end, norm) in seen:
                    why = "exact_duplicate_segment"
                elif norm in ends and norm in last and start - last[norm] <= 60_000:
                    why = "repeated_goodbye_hallucination"
                elif norm:
                    seen.add((start, end, norm))
                    last[norm] = start
            out.append(why)
        return frame[["file", "index"]].assign(reason=out)

    told = rows.select("file", "index", "start", "end", "reason", tx.normalize(F.col("text")).alias("norm"))
    told = told.groupBy("file").applyInPandas(named, "file string, index int, reason string")
    return rows.drop("reason").join(told, ["file", "index"])


def speaker_states(spark: SparkSession, path: str) -> DataFrame:
    """start, end, action of JSON lines; none if there is no file."""
    return json_lines(spark, path, "start double, end double, action string").filter("action is not null")


def dialogue(spark: SparkSession, path: str) -> DataFrame:
    """file, id, start, end, role, text, needs_review of utterances with text. Bounds fall back to those of the source, an end is never before its start, roles fold to Me and Colleagues."""
    u = json_documents(spark, path, DIALOGUE).select("file", F.posexplode("utterances").alias("i", "u")).filter(F.trim(F.coalesce("u.text", F.lit(""))) != "")
    start = F.coalesce("u.start", "u.source_start", F.lit(0.0))
    role = F.coalesce("u.speaker_label", "u.role", F.lit(""))
    folded = F.when(F.lower(role).isin("me", "mic"), "Me").when(F.lower(role).isin("remote", "colleagues", "colleague"), "Colleagues").otherwise(role)
    return u.select("file", F.coalesce("u.id", F.format_string("batch_%06d", "i")).alias("id"), start.alias("start"), F.greatest(F.coalesce("u.end", "u.source_end", start), start).alias("end"), folded.alias("role"), F.trim("u.text").alias("text"), F.coalesce("u.quality.needs_review", F.lit(False)).alias("needs_review"))


def words(segments: DataFrame) -> DataFrame:
    """file, index, place, word, start, end of speech_segments: the tokens' texts are joined and split at white space, and a word lasts as long as the tokens it touches."""
    t = segments.select("file", "index", F.posexplode("tokens").alias("k", "t"))
    order = Window.partitionBy("file", "index").orderBy("k")
    # a token that begins with white space begins a word
    t = t.withColumn("place", F.sum(F.when(F.col("t.text").rlike(r"^\s") | (F.col("k") == 0), 1).otherwise(0)).over(order))
    out = t.groupBy("file", "index", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.trim("t.text").alias("x")))), lambda s: s["x"]), "").alias("word"), F.min("t.start").alias("start"), F.max("t.end").alias("end"))
    return out.select("file", "index", F.col("place").cast("int").alias("place"), "word", "start", "end")


def range_transcript(spark: SparkSession, path: str, blocks: bool = False) -> DataFrame:
    """file, start, end, speaker, text of transcripts whose rows have a header `clock - clock`, a line with the speaker and lines of text.

    An end comes .01 s after its start at least. blocks: lines of dashes don't count, and rows without speaker or text go.
    """
    header = r"^(\d+:\d\d(?::\d\d)?)\s*(?:-|–|-->)\s*(\d+:\d\d(?::\d\d)?)$"
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\R")).alias("n", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    if blocks:
        text = text.filter(~F.col("line").rlike("^-{3,}$"))
    order = Window.partitionBy("file").orderBy("n")
    text = text.withColumn("is_header", F.col("line").rlike(header)).withColumn("row", F.sum(F.col("is_header").cast("int")).over(order)).filter("row > 0")
    text = text.withColumn("k", F.row_number().over(Window.partitionBy("file", "row").orderBy("n")))
    head = F.max(F.when(F.col("k") == 1, F.col("line")))
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") > 2, F.struct("k", "line")))), lambda x: x["line"])
    rows = text.groupBy("file", "row").agg(head.alias("h"), F.coalesce(F.max(F.when(F.col("k") == 2, F.col("line"))), F.lit("")).alias("speaker"), F.array_join(lines, " ").alias("text"))
    start, end = (tx.parse_clock(F.regexp_extract("h", header, i)).cast("double") for i in (1, 2))
    out = rows.select("file", start.alias("start"), F.greatest(end, start + 0.01).alias("end"), "speaker", "text")
    return out.filter("speaker <> '' and text <> ''") if blocks else out


def sessions(spark: SparkSession, root: str) -> DataFrame:
    """session, modified of the folders below root that hold a session.json and whose names don't begin with _, newest first."""
    files = spark.read.format("binaryFile").load(f"{root}/*/session.json").select(F.regexp_extract("path", r"([^/]+)/session\.json$", 1).alias("session"), F.col("modificationTime").alias("modified"))
    return files.filter(~F.col("session").startswith("_")).orderBy(F.desc("modified"), "session")


def policy_reasons(policies: DataFrame, files: DataFrame) -> DataFrame:
    """id, reasons of policies(id, schema_ok, state, evidence map<string, struct<path, sha256>>) against files(path, sha256): what speaks against each, in order of the keys."""
    each = policies.select("id", F.explode_outer("evidence").alias("key", "e")).select("id", "key", F.col("e.path").alias("path"), F.col("e.sha256").alias("sha256"))
    now = files.select("path", F.col("sha256").alias("_now"))
    told = each.join(now, "path", "left")
    why = F.when(F.col("key").isNull(), None).when(F.col("_now").isNull(), F.concat(F.lit("policy_evidence_missing:"), F.col("key"))).when(~F.col("_now").eqNullSafe(F.col("sha256")), F.concat(F.lit("policy_evidence_stale:"), F.col("key")))
    per = told.withColumn("why", why).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("why").isNotNull(), F.struct("key", "why")))), lambda x: x["why"]).alias("_w"))
    base = F.array_compact(F.array(F.when(~F.col("schema_ok"), F.lit("selector_policy_schema_invalid")), F.when(F.col("state") != "promoted", F.lit("selector_policy_not_promoted"))))
    return policies.join(per, "id").select("id", F.concat(base, "_w").alias("reasons"))


def write_json_lines(rows: DataFrame, path: str, by: str, order: list[str]) -> None:
    """JSON lines in a folder for each value of `by`, rows in order, doubles rounded to milliseconds."""
    rounded = [F.round(f.name, 3).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in rows.schema]
    rows.select(*rounded).repartition(by).sortWithinPartitions(by, *order).write.mode("overwrite").partitionBy(by).json(path)


def obsidian_notes(sessions_: DataFrame, transcripts: DataFrame) -> DataFrame:
    """session, note: front matter of sessions_(session, profile, verdict, use_gate, generated) and an index over the Markdown of transcripts(session, markdown)."""
    front = F.concat_ws("\n", F.lit("---"), *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in ("session", "profile", "verdict", "use_gate", "generated")], F.lit("---"))
    body = F.concat(F.lit("# "), F.col("session").cast("string"), F.lit("\n\n"), F.coalesce("markdown", F.lit("> [!warning] no transcript, needs review")))
    return sessions_.join(transcripts, "session", "left").select("session", F.concat_ws("\n\n", front, body).alias("note"))
