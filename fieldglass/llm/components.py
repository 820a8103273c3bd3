"""Connected components of an edge table by alternating star steps, each an aggregation and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every neighbour greater than the node is tied to the node's least neighbour. Small: every lesser one, and the node itself."""
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    out = near.join(least, "u")
    out = out.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """edges: u, v. Returns `node` and `component`, the least node reachable, for every node but the least of each component.

    Each round's edges are written to the shared folder, so a lost executor costs one round. Rounds grow with the logarithm
    of the longest path.
    """
    now = materialize(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        now = materialize(_star(_star(now, True), False), "edges")
        # Settled: every node has one edge, to a node that has none.
        ends = now.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("up"))
        loose = now.join(ends, F.col("v") == F.col("node"), "left_semi").select("u").unionByName(ends.where("up > 1").select(F.col("node").alias("u")))
        if not loose.take(1):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
