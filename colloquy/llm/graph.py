"""Connected components of links, by alternating large-star and small-star steps over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.storage import discard, materialize


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, component (the smallest node reachable) for every node of links(a, b) that has a partner; order and repeats of a, b don't matter.

    Each step is two sums by node and two joins; hubs are left to skew-join splitting. Steps end when all nodes point at a
    root, after a number of steps that grows with the logarithm of the longest path.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = materialize(links, name)
    while True:
        roots = links.select(F.col("u").alias("v")).distinct()
        if links.join(roots, "v", "left_semi").isEmpty():
            two = links.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("w"))
            if two.filter("v <> w").isEmpty():
                break
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, links = links, materialize(small.unionAll(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), name)
        discard(before)
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
