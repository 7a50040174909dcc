"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset a temporary one, but only for a session that runs on this machine alone."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="colloquy-"))
    return _own_folder[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet under a fresh name in the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Empties a table of materialize that nothing reads any more, so that its files don't outlive their use."""
    files = table.inputFiles()
    if files:
        table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])


def bound_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """From now on, Arrow batches of this session hold no more than so much, whatever the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")
