"""What is reached along chains, where every node has one next node at most: pointers are doubled, so the rounds are the logarithm of the longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblathe.operators.store import kept


def first_along(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """Which start reaches a node first, by the number of steps t and then by r: (at, t, r, run, via), starts with t = 0 too.

    steps(at, to, since): the next node of each; since is 0 where the step begins a run anew, else null. starts(at, r, run). run: steps since a run began. via: the node before.
    After round i the nodes within 2^i steps are known; a round that reaches no new node is the last, as then no step leads out of what is known.
    """
    steps = steps.select("at", "to", F.col("at").alias("via"), F.col("since").cast("int").alias("since"))
    found = kept(starts.select("at", F.lit(0).alias("t"), "r", F.col("run").cast("int").alias("run"), F.lit(None).cast("long").alias("via")))
    n, length = found.count(), 1
    while True:
        moved = found.drop("via").join(steps, "at").select(
            F.col("to").alias("at"), (F.col("t") + length).alias("t"), "r", F.coalesce("since", F.col("run") + length).alias("run"), "via"
        )
        found = kept(found.unionByName(moved).groupBy("at").agg(F.min(F.struct("t", "r", "run", "via")).alias("m")).select("at", "m.*"))
        before, n = n, found.count()
        if n == before:
            return found
        later = steps.select(F.col("at").alias("to"), F.col("to").alias("end"), F.col("via").alias("last"), F.col("since").alias("later_since"))
        steps = kept(steps.join(later, "to").select("at", F.col("end").alias("to"), F.col("last").alias("via"), F.coalesce("later_since", F.col("since") + length).alias("since")))
        length *= 2
