"""Connected components of a graph given as edges between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.base import written


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) for every node of ``edges`` (a, b).

    Alternating rounds of two steps until nothing changes: every node hands the
    smallest neighbour to its larger neighbours, then to its smaller ones
    (large star, small star).  Each round is a shuffle of edges; their number
    never grows, and the rounds grow with the logarithm of the longest path.
    A node with very many neighbours is a minimum in a partial aggregation and
    a join that Spark can split.
    """
    pairs = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: neighbours above u go to u's minimum
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "large")
        # small star: neighbours below u, and u, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        below = large.join(least, "u")
        small = below.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        small = written(small, "small")
        settled = small.exceptAll(pairs).isEmpty() and pairs.exceptAll(small).isEmpty()
        pairs = small
        if settled:
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
