"""Content-addressed refresh of a computed table: a chunk's result is kept under the hash of all that it was made from.

A chunk's identity is the hash of its content, of the chunks before it in its session, and of the parameters. Results that are
kept under an identity and still intact are read, all others are computed, appended and read with them; nothing that is kept
is ever changed, so a refresh that stops halfway leaves the table as it was.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.operators.intervals import with_carry
from colloquy.operators.joins import null_safe

IDENTITY, ENTRY = "colloquy.identity/1", "colloquy.entry/1"
#: Consecutive chunks of a session whose running sums are made in one group.
CHUNKS_TOGETHER = 1000


def _number(digest: Column, start: int) -> Column:
    """Twelve hexadecimal digits as a whole number."""
    return F.conv(F.substring(digest, start, 12), 16, 10).cast("decimal(38,0)")


def _output() -> Column:
    """The hash of a result; null counts as empty."""
    return F.sha2(F.coalesce("payload", F.lit("")), 256)


def identities(chunks: DataFrame, key: str, index: str, content: str, parameters: dict) -> DataFrame:
    """chunks(key, index, content, ...) with `context` (two sums over the hashes of the key's earlier chunks), `identity` (JSON) and `identity_sha256`.

    A null content counts as empty; null keys and null indexes are keys and indexes of their own, a null index comes first.
    Chunks of one index are earlier than none of each other. Sums are carried between groups of chunks, so a session of any
    length is no task of its own.
    """
    text = F.coalesce(F.col(content), F.lit(""))
    digest = F.sha2(F.concat_ws(":", F.coalesce(F.col(index).cast("string"), F.lit("null")), text), 256)
    per = chunks.select(key, index, digest.alias("_d")).groupBy(key, index).agg(F.sum(_number(F.col("_d"), 1)).alias("_x"), F.sum(_number(F.col("_d"), 13)).alias("_y"))
    per = per.withColumn("_k", F.coalesce(F.floor(F.col(index) / CHUNKS_TOGETHER), F.lit(-1 << 40)))
    before = Window.partitionBy(key, "_k").orderBy(F.asc_nulls_first(index)).rowsBetween(Window.unboundedPreceding, -1)
    carried = with_carry(per, [key], {"_bx": (F.sum("_x"), F.sum), "_by": (F.sum("_y"), F.sum)})
    sums = [F.coalesce(F.col(f"_b{c}"), F.lit(0)) + F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)) for c in "xy"]
    context = carried.select(key, index, F.concat_ws("-", *[s.cast("decimal(38,0)").cast("string") for s in sums]).alias("context"))
    out = null_safe(chunks, context, [key, index])
    fields = [F.lit(IDENTITY).alias("schema"), F.col(key).alias("key"), F.col(index).alias("index"), F.sha2(text, 256).alias("content"), F.col("context"), F.lit(json.dumps(parameters, sort_keys=True, separators=(",", ":"))).alias("parameters")]
    return out.withColumn("identity", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})).withColumn("identity_sha256", F.sha2("identity", 256))


def validate(expected: DataFrame, stored: DataFrame, on: list[str]) -> DataFrame:
    """expected's keys with `hit` and `reason`, the first check that the stored entry fails, or exact_identity_and_integrity_match.

    expected are rows(on, identity_sha256, input_sha256: what the input's hash has to be); stored are rows(on, schema,
    completed, identity, stored_sha256: the identity's hash as noted, input_now: the input's hash now or null if it is gone,
    input_readable, output_sha256: as noted, output_now: now or null if it is gone, payload_valid), one for each key at most.
    """
    both = null_safe(expected, stored.withColumn("_there", F.lit(True)), on, "left")

    def no(column: str) -> Column:
        return ~F.coalesce(F.col(column), F.lit(False))

    ladder = [
        (no("_there"), "metadata_missing_or_invalid"),
        (~F.coalesce(F.col("schema") == ENTRY, F.lit(False)) | no("completed"), "cache_entry_schema_or_completion_mismatch"),
        (F.col("identity").isNull(), "identity_missing"),
        (~F.col("stored_sha256").eqNullSafe(F.sha2("identity", 256)), "stored_identity_hash_mismatch"),
        (~F.col("identity_sha256").eqNullSafe(F.sha2("identity", 256)), "canonical_identity_mismatch"),
        (F.col("input_now").isNull(), "canonical_input_missing"),
        (no("input_readable"), "canonical_input_invalid"),
        (~F.col("input_now").eqNullSafe(F.col("input_sha256")), "canonical_input_hash_mismatch"),
        (F.col("output_now").isNull(), "output_missing"),
        (~F.col("output_now").eqNullSafe(F.col("output_sha256")), "output_hash_mismatch"),
        (no("payload_valid"), "output_payload_invalid"),
    ]
    reason = F.coalesce(*[F.when(when, F.lit(text)) for when, text in ladder], F.lit("exact_identity_and_integrity_match"))
    return both.select(*on, "identity_sha256", reason.alias("reason")).withColumn("hit", F.col("reason") == "exact_identity_and_integrity_match")


def entries(spark: SparkSession, store: str, payload: str = "string") -> DataFrame:
    """What the store keeps: identity, its hash, the payload, the hash of the payload; no rows for a store that isn't there yet."""
    shape = f"schema string, completed boolean, identity string, stored_sha256 string, payload {payload}, output_sha256 string"
    try:
        return spark.read.schema(shape).parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], shape)


def missing(wanted: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of identities() that the store has no intact result of."""
    intact = kept.filter((F.col("schema") == ENTRY) & F.col("completed") & (F.sha2("identity", 256) == F.col("stored_sha256")) & (_output() == F.col("output_sha256")))
    return wanted.join(intact.select(F.col("stored_sha256").alias("identity_sha256")).distinct(), "identity_sha256", "left_anti").select(*wanted.columns)


def refresh(chunks: DataFrame, key: str, index: str, content: str, parameters: dict, store: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """chunks with identity_sha256 and `payload`, of which only those that the store doesn't hold intact are computed.

    compute gets rows of chunks with their identities and returns (identity_sha256, payload string), one for each identity. A
    chunk that changes changes its own identity and those of all chunks behind it in its session. Chunks of equal identity
    share one result. Old results stay in the store. An empty table gives no rows.
    """
    spark = chunks.sparkSession
    wanted = identities(chunks, key, index, content, parameters)
    todo = missing(wanted, entries(spark, store))
    if todo.limit(1).count():
        made = compute(todo).select("identity_sha256", "payload").groupBy("identity_sha256").agg(F.first("payload").alias("payload"))
        named = todo.groupBy("identity_sha256").agg(F.first("identity").alias("identity"))
        rows = made.join(named, "identity_sha256").select(F.lit(ENTRY).alias("schema"), F.lit(True).alias("completed"), "identity", F.col("identity_sha256").alias("stored_sha256"), "payload", _output().alias("output_sha256"))
        rows.write.mode("append").parquet(store)
    held = entries(spark, store).filter(_output() == F.col("output_sha256")).groupBy(F.col("stored_sha256").alias("identity_sha256")).agg(F.first("payload").alias("payload"))
    return wanted.join(held, "identity_sha256").select(*wanted.columns, "payload")
