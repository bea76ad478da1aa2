"""Connected components of an edge list, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblathe.llm.common import kept


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """edges(a long, b long) -> (node, component), component the smallest node of it; nodes without edges aren't there.

    Each round sends every node's neighbours to the smallest of them (large star), then every node's smaller
    neighbours to the smallest (small star), until the edges are stars. Groups are reduced to their minimum by
    aggregation, so that no group is gathered in one place; a hub's rows are joined with its one minimum.
    """
    now = kept(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(lower, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = kept(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct())
        centres = new.select("b").distinct().join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        stars = new.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() == 0 and centres.limit(1).count() == 0
        now = new
        if stars:
            break
    else:
        raise RuntimeError(f"not done after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
