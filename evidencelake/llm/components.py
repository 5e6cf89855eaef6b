"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm._store import cut, forget


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a node without one: the components are stars."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    nodes = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return nodes.where("out > 1 OR out > 0 AND into > 0").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours; a link may come twice."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Columns ``node`` and ``component`` (its smallest node) of all nodes in ``edges`` (u, v: long).

    Each round is two aggregations with map-side combining and two equi-joins;
    no neighbour list is ever gathered, so a node with a third of all edges is
    only a skewed join key, which adaptive execution splits.  The rounds end when
    every component is a star, or after ``rounds``: nodes of one component then
    are connected, but connected nodes may still have several components.  Loops
    and repeated edges are allowed; rows with a null end are dropped.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    done = 0
    while done != rounds and not _stars(now):
        before, now = now, cut(_small_star(_large_star(now)), "edges")
        forget(before)
        done += 1
    least = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = now.select(F.col("v").alias("node")).distinct().join(least, "node", "left_anti").select("node", F.col("node").alias("component"))
    return least.unionByName(roots)
