"""Joins that keep null keys, and rows dealt to all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left with right's other columns, where all keys are equal or both null; the key columns are left's. Still an equality join, so it is hashed or sorted by key."""
    other = right.select(*[F.col(c).alias(f"_{c}_of_right") for c in on], *[c for c in right.columns if c not in on])
    same = None
    for c in on:
        one = left[c].eqNullSafe(F.col(f"_{c}_of_right"))
        same = one if same is None else same & one
    joined = left.join(other, same, how) if on else left.join(other, how="cross")
    return joined.drop(*[f"_{c}_of_right" for c in on])


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by their keys over all shuffle partitions, however few bytes they are: for steps whose rows cost much time."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
