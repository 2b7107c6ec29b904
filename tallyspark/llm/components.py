"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(``id``, ``root``) for every node of ``edges`` (``a``, ``b``, longs): the smallest id that it reaches.

    Each round hooks every node's larger neighbours, and then its smaller ones,
    to the smallest; the rounds grow with the logarithm of a component's size.
    All joins are on node ids against one row per node, so that the rows of a
    node with many edges can be split.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                  "stars")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = written(small, "stars")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
