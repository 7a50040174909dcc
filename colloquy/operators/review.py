"""Review queues and decisions: priorities, quotas, conflicts, progress, gates and lifecycle rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators.intervals import with_carry


def ladder(default: str, *steps: tuple[Column, str]) -> Column:
    """The answer of the first condition that holds."""
    out = F
    for condition, answer in steps:
        out = out.when(condition, F.lit(answer))
    return out.otherwise(F.lit(default))


def flags(*named: tuple[str, Column]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named]))


def review_queue(rows: DataFrame, lane: str, lanes: list[str], reserved: list[str], each: int, limit: int, order: list[Column]) -> DataFrame:
    """The best `each` of the reserved lanes, then the best of the rest, limit rows in all, with their place by lane order and then order.

    Only rows among the first `limit` of their lane can be chosen, so those of one lane are ranked by a top-k and not sorted whole.
    """
    place = F.array_position(F.array(*map(F.lit, lanes)), F.col(lane))
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(lane).orderBy(*order))).filter(F.col("_r") <= limit)
    kept = first.withColumn("_rest", ~(F.col(lane).isin(reserved) & (F.col("_r") <= each))).orderBy("_rest", *order).limit(limit)
    return kept.withColumn("place", F.row_number().over(Window.orderBy(place, *order))).drop("_r", "_rest")


def group_key() -> Column:
    """Key of the piece of work that a review item belongs to: by its turn across lanes where audio decides, by turn, label and action in the order lane, else its own."""
    lane, alone = F.col("review_lane"), F.concat(F.lit("own:"), F.col("id").cast("string"))
    session, me = F.col("session").cast("string"), F.col("me_id").cast("string")
    key = F.when(F.col("me_id").isNull(), alone).when(lane.isin("check_unique_me_content", "classify_audio"), F.concat_ws(":", F.lit("cross_lane_me_audio"), session, me))
    return key.when(lane == "check_transcript_order", F.concat_ws(":", lane, session, F.col("label"), F.col("review_action"), me)).otherwise(alone)


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def progress(rows: DataFrame, key: str, done: Column, seconds: str, decisions: dict[str, Column] | None = None) -> DataFrame:
    """key (null as unknown), total, reviewed, remaining, ratio, seconds, remaining seconds, and a count for each decision."""
    by = rows.groupBy(F.coalesce(F.when(F.col(key) != "", F.col(key)), F.lit("unknown")).alias(key))
    out = by.agg(F.count("*").alias("total"), F.count_if(done).alias("reviewed"), F.sum(seconds).alias("seconds"), F.sum(F.when(done, 0).otherwise(F.col(seconds))).alias("remaining_seconds"), *[F.count_if(c).alias(n) for n, c in (decisions or {}).items()])
    return out.withColumn("remaining", F.col("total") - F.col("reviewed")).withColumn("ratio", F.col("reviewed") / F.col("total"))


def settle_conflicts(decisions: DataFrame, target: str, decision: str) -> DataFrame:
    """decisions with `settled`: a drop of a target that also has another decision becomes needs_review."""
    drop = F.col(decision) == "drop"
    mixed = decisions.groupBy(target).agg((F.bool_or(drop) & F.bool_or(~drop)).alias("_mixed"))
    out = decisions.join(mixed, target, "left").withColumn("settled", F.when(F.col("_mixed") & drop, "needs_review").otherwise(F.col(decision)))
    return out.drop("_mixed")


def check_rows(metrics: DataFrame, checks: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """A row (id, severity, status, observed) for each check and row of metrics."""
    made = [F.struct(F.lit(i).alias("id"), F.lit(s).alias("severity"), F.when(ok, "pass").otherwise("fail").alias("status"), seen.cast("double").alias("observed")) for i, s, ok, seen in checks]
    return metrics.select("*", F.explode(F.array(*made)).alias("_c")).select(*metrics.columns, "_c.*")


def identity_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path, problem for expected(path, bytes, sha256) that are missing or changed; files that nobody expects aren't reported."""
    both = expected.join(actual.select("path", F.col("bytes").alias("_b"), F.col("sha256").alias("_s"), F.lit(True).alias("_there")), "path", "left")
    problem = F.when(F.col("_there").isNull(), "missing").when(F.col("bytes") != F.col("_b"), "size_changed").when(F.col("sha256").isNotNull() & (F.col("sha256") != F.col("_s")), "sha256_changed")
    return both.select("path", problem.alias("problem")).filter("problem is not null")


def age_seconds(value: Column) -> Column:
    """30m, 24h, 7d or 4w as seconds; null for anything else."""
    n = F.regexp_extract(value, r"^(\d+)([mhdw])$", 1).try_cast("long")
    unit = F.regexp_extract(value, r"^(\d+)([mhdw])$", 2)
    return n * F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 604800)


def inventory_fingerprint(files: DataFrame, by: list[str]) -> DataFrame:
    """by and the SHA-256 over path NUL bytes LF of each inventory of files(path, bytes), in path order; an inventory is one session's and fits in a task."""
    line = F.concat(F.col("path"), F.lit("\0"), F.col("bytes").cast("string"), F.lit("\n"))
    lines = F.array_sort(F.collect_list(F.struct(F.col("path").alias("p"), line.alias("l"))))
    return files.groupBy(*by).agg(F.sha2(F.array_join(F.transform(lines, lambda x: x["l"]), ""), 256).alias("fingerprint"))


def ranked(rows: DataFrame, by: list[str], order: list[str], bucket: Column, name: str = "rank") -> DataFrame:
    """rows with their rank, from 1, in the key: inside buckets, which must follow the order, plus the counts of earlier buckets."""
    out = with_carry(rows.withColumn("_k", bucket), by, {"_before": (F.count("*"), F.sum)})
    return out.withColumn(name, F.coalesce("_before", F.lit(0)) + F.row_number().over(Window.partitionBy(*by, "_k").orderBy(*order))).drop("_k", "_before")


def even_sample(rows: DataFrame, by: list[str], key: str, k: int, width: int = 10_000) -> DataFrame:
    """The rows at places floor(i * (n - 1) / (k - 1)) of each group in key order: at most k, evenly spread."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    out = ranked(rows, by, [key], F.floor(F.col(key) / width), "_i").join(sizes, by)
    hit = F.exists(F.array(*map(F.lit, range(k))), lambda i: F.floor(i * (F.col("_n") - 1) / float(max(k - 1, 1))) == F.col("_i") - 1)
    return out.filter(hit).drop("_i", "_n")


def decisions_match(evidence: DataFrame, dialogue: DataFrame, decision: str, turn: str) -> DataFrame:
    """decision, matches: whether every turn of evidence(decision, turn, text, role) is in dialogue(turn, text, role) with the same normalised text and, unless Unknown, role."""
    now = dialogue.select(turn, F.col("text").alias("_text"), F.col("role").alias("_role"))
    same = (tx.normalize(F.col("text")) == tx.normalize(F.col("_text"))) & ((F.col("role") == "Unknown") | (F.col("role") == F.col("_role")))
    return evidence.join(now, turn, "left").groupBy(decision).agg(F.bool_and(F.coalesce(same, F.lit(False))).alias("matches"))


def unique_topk(rows: DataFrame, signature: list[str], order: list[Column], limit: int) -> DataFrame:
    """The best row of each signature, then the best of these."""
    return top_per_group(rows, signature, order, 1).drop("rank").orderBy(*order).limit(limit)


def first_profile(rows: DataFrame, key: str, cascade: list[tuple[str, Column]], default: str) -> DataFrame:
    """key, profile: the first of the cascade whose condition some row of the key meets."""
    return rows.groupBy(key).agg(F.coalesce(*[F.max(F.when(c, F.lit(n))) for n, c in cascade], F.lit(default)).alias("profile"))


def last_wins(parts: list[DataFrame], key: str, side: str) -> DataFrame:
    """The rows of all parts, numbered by their part in `side`; of one key the row of the last part stays. A part has a key once."""
    both = parts[0].withColumn(side, F.lit(0))
    for i, part in enumerate(parts[1:], 1):
        both = both.unionByName(part.withColumn(side, F.lit(i)))
    row = F.max_by(F.struct(*both.columns), F.col(side)).alias("r")
    return both.groupBy(key).agg(row).select("r.*")
