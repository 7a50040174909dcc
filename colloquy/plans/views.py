"""Views of the driver tables as conversations, in Spark and as SQL: intervals of events, turns with times, words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INTERVALS_SQL = """iv AS (SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS day, event_type AS track, user_id, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + CAST(floor(value * 1000) AS BIGINT) AS e FROM events)"""
TURNS_SQL = """turns AS (SELECT *, s + (length(text) * 1000) // 15 AS e FROM (SELECT conv_id AS session, turn, CASE role WHEN 'user' THEN 'mic' WHEN 'assistant' THEN 'remote' ELSE 'other' END AS track, text,
 CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) * 1000 // 15 AS s FROM conversations))"""
WORDS_SQL = """words AS (SELECT session, turn, track, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') AS tokens FROM turns)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, day, track, user_id, start, end in milliseconds: events as intervals of their value in seconds."""
    start = F.unix_millis("ts")
    ts = F.col("ts").cast("timestamp")
    e = table(spark, sf_dir, "events").withColumn("ts", ts)
    return e.select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("track"), "user_id", start.alias("start"), (start + F.floor(F.col("value") * 1000)).alias("end"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, turn, track, text, start, end in milliseconds, at fifteen characters a second."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    c = table(spark, sf_dir, "conversations").withColumn("_before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))
    track = F.when(F.col("role") == "user", "mic").when(F.col("role") == "assistant", "remote").otherwise("other")
    out = c.select(F.col("conv_id").alias("session"), "turn", track.alias("track"), "text", F.expr("_before * 1000 div 15").alias("start"))
    return out.withColumn("end", F.expr("start + length(text) * 1000L div 15"))


def _with_tokens(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tokens", F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != ""))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, turn, track, tokens: lower-case runs of a-z."""
    return _with_tokens(turns(spark, sf_dir)).select("session", "turn", "track", "tokens")


def share(a: int, m: int = 101) -> str:
    """SQL, the same in both engines, of a number from 0 to 1 that looks random over event_id."""
    return f"((event_id * {a}) % {m}) / {m}e0"


def count(a: int, m: int) -> str:
    return f"(event_id * {a}) % 9973 % {m}"


def flag(a: int, m: int) -> str:
    return f"(event_id * {a}) % 9973 % {m} = 0"


def pick(a: int, *values: str | None) -> str:
    cases = " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values))
    return f"CASE (event_id * {a}) % 9973 % {len(values)} {cases} END"


def evidence(spark: SparkSession, sf_dir: str, fields: dict[str, str]) -> DataFrame:
    """id and the fields, computed from event_id by their SQL: evidence columns for the decision ladders."""
    return table(spark, sf_dir, "events").selectExpr("event_id AS id", *[f"{sql} AS {name}".replace("ARR(", "array(") for name, sql in fields.items()])


def evidence_sql(fields: dict[str, str]) -> str:
    return f"x AS (SELECT event_id AS id, {', '.join(f'{sql} AS \"{name}\"' for name, sql in fields.items())} FROM events)".replace("ARR(", "list_value(")


_CONTENT = "len(list_distinct(list_filter(tokens, lambda t: length(t) >= 3 AND t NOT IN ('the', 'and', 'that', 'with', 'for'))))"
#: Live turns and the batch transcript of the same sessions: later by up to two seconds, some rows lost, cut short or of another role.
LIVE_SQL = f"""{TURNS_SQL}, {WORDS_SQL}, live AS (SELECT session, turn AS id, turn // 6 AS chunk, CASE track WHEN 'mic' THEN 'Me' WHEN 'remote' THEN 'Colleagues' ELSE 'Other' END AS role, s, e, tokens, {_CONTENT} AS content, text FROM turns JOIN words USING (session, turn, track)),
batch AS (SELECT session, id + 1000 AS id, chunk, CASE WHEN id % 5 = 0 THEN 'Me' WHEN id % 5 = 1 THEN 'Colleagues' ELSE role END AS role, s + id % 4 * 700 AS s, e + id % 4 * 700 AS e, CASE WHEN id % 3 = 0 THEN tokens[1:greatest(len(tokens) - 1, 0)] ELSE tokens END AS tokens, content, id % 11 = 0 AS suspicious, text FROM live WHERE id % 7 <> 6)"""


def live_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _with_tokens(turns(spark, sf_dir))
    content = F.array_distinct(F.filter("tokens", lambda t: (F.length(t) >= 3) & ~t.isin("the", "and", "that", "with", "for")))
    role = F.when(F.col("track") == "mic", "Me").when(F.col("track") == "remote", "Colleagues").otherwise("Other")
    return both.select("session", F.col("turn").cast("long").alias("id"), F.expr("turn div 6").alias("chunk"), role.alias("role"), "start", "end", "tokens", F.size(content).alias("content"), "text")


def batch_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live_turns(spark, sf_dir).filter("id % 7 <> 6")
    late = F.col("id") % 4 * 700
    cut = F.when(F.col("id") % 3 == 0, F.slice("tokens", F.lit(1), F.greatest(F.size("tokens") - 1, F.lit(0)))).otherwise(F.col("tokens"))
    role = F.when(F.col("id") % 5 == 0, "Me").when(F.col("id") % 5 == 1, "Colleagues").otherwise(F.col("role"))
    return rows.select("session", (F.col("id") + 1000).alias("id"), "chunk", role.alias("role"), (F.col("start") + late).alias("start"), (F.col("end") + late).alias("end"), cut.alias("tokens"), "content", (F.col("id") % 11 == 0).alias("suspicious"), "text")
