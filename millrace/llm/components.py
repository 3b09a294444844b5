"""Connected components by alternating large and small stars, every round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long).  Returns u, v: every node but the smallest of its component, and that smallest.

    Rounds grow with the logarithm of the longest path.  The driver sees a count and a checksum each round.  Minima are written
    before they are joined, so that both sides of a join are plain exchanges and Spark can split the rows of a hot centre.
    """
    ordered = lambda df: df.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    held, before = written(ordered(edges), "edges"), None
    while True:
        now = held.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 24))).first()
        if now == before:
            return held
        before = now
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(ordered(large), "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        held = written(ordered(small), "edges")
