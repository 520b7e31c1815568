"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import dropped, written

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of long nodes -> (node, root), root the smallest node reachable; nodes without links don't appear.

    Each round hangs every neighbour on the smallest one known (large star, then small star); the rounds needed
    grow with the logarithm of the longest path. Each is written to the shared folder, so lineage stays short.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        last, edges = edges, written(small.filter("u <> v").distinct())
        dropped(last)
        now = tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.count_if(F.col("u").isNull())).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
