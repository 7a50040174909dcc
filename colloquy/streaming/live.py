"""Live segments as streams: pairing of tracks, session windows, stateful removal of repeats, commit delay."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SEGMENTS = "session string, source string, index int, start double, end double, text string, closed boolean, t timestamp"


def paired(segments: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """session, index with both tracks' texts, once the mic and the remote segment are closed; state is bounded by the delay."""

    def side(source: str) -> DataFrame:
        rows = segments.filter(F.col("closed") & (F.col("source") == source)).withWatermark("t", delay)
        return rows.select("session", "index", *[F.col(c).alias(f"{source}_{c}") for c in ("start", "end", "text", "t")])

    mic, remote = side("mic").alias("m"), side("remote").alias("r")
    near = F.expr(f"r.remote_t between m.mic_t - interval {delay} and m.mic_t + interval {delay}")
    return mic.join(remote, (F.col("m.session") == F.col("r.session")) & (F.col("m.index") == F.col("r.index")) & near).select("m.*", *[F.col(f"r.remote_{c}") for c in ("start", "end", "text")])


def speech_sessions(events: DataFrame, key: str, gap_seconds: int, delay: str = "10 minutes") -> DataFrame:
    """key, start, end, n: events(key, t, seconds) merged where one begins within the gap after another's end."""
    gap = F.concat((F.col("seconds") + gap_seconds).cast("int").cast("string"), F.lit(" seconds"))
    out = events.withWatermark("t", delay).groupBy(key, F.session_window("t", gap)).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def without_repeats(segments: DataFrame, recall: float = 0.8, idle_minutes: int = 240) -> DataFrame:
    """session, index, text, kept: a segment goes if the last one kept in its session has most of its words, as a multiset.

    The state of a session is the words of one segment. It ends when a session has been silent for `idle_minutes`. Segments
    of a micro-batch are taken in the order of their index.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("index")
        kept = []
        for text in rows["text"]:
            words = str(text or "").lower().split()
            shared = (Counter(words) & Counter(last)).total()
            new = not words or not last or shared < recall * len(words)
            kept.append(new)
            last = words if new else last
        state.update((last,))
        state.setTimeoutDuration(idle_minutes * 60_000)
        yield pd.DataFrame({"session": rows["session"], "index": rows["index"], "text": rows["text"], "kept": kept})

    return segments.groupBy("session").applyInPandasWithState(step, "session string, index int, text string, kept boolean", "words array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


LAG = "session string, index int, end double, run boolean, observed_live_lag_sec double, max_live_lag_sec double, reason string"


class LagBudget(StatefulProcessor):
    """Decides for each chunk of a session whether its optional stage still runs, by how far the chunk lags behind what has been captured.

    The state of a session is one number, the latest end captured so far; an event-time timer clears it when the session has
    been silent. A chunk that lags too far loses its optional stage, never its row; a budget of 0 or less lets all run.
    """

    def __init__(self, most: float, idle_ms: int):
        self.most, self.idle_ms = most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.captured = handle.getValueState("captured", "captured double")

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows)).sort_values(["t", "index"], kind="stable")
        latest = self.captured.get()[0] if self.captured.exists() else 0.0
        ends = frame["end"].astype(float)
        captured = ends.cummax().clip(lower=latest)
        lag = (captured - ends).clip(lower=0.0)
        run = (lag <= self.most) if self.most > 0 else lag == lag
        self.captured.update((float(captured.iloc[-1]),))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(int(frame["t"].max().timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield pd.DataFrame({"session": frame["session"], "index": frame["index"].astype("int32"), "end": ends, "run": run, "observed_live_lag_sec": lag.round(3), "max_live_lag_sec": round(self.most, 3), "reason": ["within_lag_budget" if r else "live_lag_budget_exceeded" for r in run]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.captured.clear()
        return iter(())

    def close(self) -> None:
        pass


def lag_decisions(segments: DataFrame, most: float, delay: str = "10 minutes", idle_minutes: int = 240) -> DataFrame:
    """A row of LAG for every streamed segment(session, index, end, t) that comes before the watermark has passed it.

    The watermark follows the latest t less the delay; segments that come later than that are left out by Spark, and a
    session's state goes once the watermark is idle_minutes beyond its last segment. Within a micro-batch segments count in
    the order of t and index. Needs the RocksDB state store.
    """
    rows = segments.select("session", "index", "end", "t").withWatermark("t", delay)
    return rows.groupBy("session").transformWithStateInPandas(LagBudget(most, idle_minutes * 60_000), LAG, "Append", "eventTime")


def write_draft(segments: DataFrame, path: str, checkpoint: str):
    """Keeps a draft of streamed segments at path: each micro-batch appends its rows, told apart by batch, and readers see with `draft` what is provisional."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return segments.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()


def draft(spark: SparkSession, path: str, commit_delay: float) -> DataFrame:
    """The draft so far: the last version of each segment, with `provisional`."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    last = rows.groupBy("session", "source", "index").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("session", "source", "index", "batch")]), "batch").alias("r"))
    return provisional(last.select("session", "source", "index", "r.*"), commit_delay)


def provisional(segments: DataFrame, commit_delay: float) -> DataFrame:
    """segments of a batch with `provisional`: those that end less than the delay before the session's latest end."""
    latest = segments.groupBy("session").agg(F.max("end").alias("_latest"))
    return segments.join(latest, "session").withColumn("provisional", F.col("_latest") - F.col("end") < commit_delay).drop("_latest")
