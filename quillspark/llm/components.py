"""Connected components of an edge table by alternating large-star and small-star steps, each written to shared storage.

Defined cases: an edge with a null end joins nothing and is left out, as is one from a node to itself; repeated edges count
once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node in ``edges`` (``a, b``; any order, repeats allowed); root is its component's least node.

    Both steps reduce a node's neighbours to their least one (partial minima, so a node of very many links is one row a
    task) and join that back; no neighbour list is ever built. The number of steps grows with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        older = (now._scratch, large._scratch)
        now = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(spark, *older)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
