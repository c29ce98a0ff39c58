"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    ``edges`` has u and v of one ordered type; loops, repeats and either direction are allowed, rows with a
    null are left out. Each step is a written table; the loop ends when a step changes nothing, after a
    number of steps that grows with the logarithm of the longest path. Without edges the result is empty.
    """
    step = scratch.table(edges.where("u != v").select("u", "v").distinct(), f"{name}-0")
    sign, k = None, 0
    while True:
        k += 1
        stars = scratch.table(_large_star(step).where("u != v").distinct(), f"{name}-{k}-large")
        after = scratch.table(_small_star(stars).where("u != v").distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k}-large", f"{name}-{k - 1}")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign or now[0] == 0:
            break
        step, sign = after, now
    roots = after.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
