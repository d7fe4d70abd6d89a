"""Connected components of a graph given by edges, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def connected(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node that it reaches.

    Large-star and small-star steps take turns (Kiveris et al., 2014): each
    hangs a node's larger, then its other neighbours on the least one, until
    nothing changes; the rounds grow with the logarithm of a chain's length.
    Sums of the edges tell of a change; edges themselves stay in the cluster,
    and each round is written to the shared folder.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    print_before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        own = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(own, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(own).where("a <> b").distinct()
        before, edges = edges, stored(small)
        forget(before)
        print_now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if print_now == print_before:
            break
        print_before = print_now
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
