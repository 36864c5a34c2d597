"""Connected components of a link table, by alternating star steps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, label`` for every node of ``edges (a, b)``; the label is the smallest node reachable.

    A large star links each node's larger neighbours to its smallest one; a small star does the same with its smaller
    neighbours. Both lower the links until each component is a star around its smallest node. A step is
    a pre-aggregated minimum and an equi-join, so a node with very many links is never gathered; each step's
    links are written, which cuts the lineage. The number of steps grows with the logarithm of a component's width.
    """
    now = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .where("a != b").distinct(), f"{name}-0")
    step, seen = 0, None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a != b").distinct())
        large = scratch.write(large, f"{name}-{step}-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.greatest("b", "m").alias("x"), F.least("b", "m").alias("y"))
                 .where("x != y").unionByName(low.select(F.col("a").alias("x"), F.col("m").alias("y"))).distinct())
        after = scratch.write(small.select(F.col("x").alias("a"), F.col("y").alias("b")), f"{name}-{step + 1}")
        scratch.drop(f"{name}-{step}", f"{name}-{step}-large")
        now, step = after, step + 1
    stars = now.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
    return stars.unionByName(now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("label"))
                             .join(stars.select("node"), "node", "left_anti"))
