"""Connected components of an edge table by alternating star steps, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    ends = F.array(*[F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in "vu"])
    return down.join(low, "u").select(F.explode(ends).alias("e")).select("e.*").where("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node of ``edges``, from larger to smaller nodes, has one edge down or only edges up."""
    ends = (edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
            .unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))))
    other = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR down + up > 1")
    return other.agg(F.count(F.lit(1))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes in ``edges`` (a, b): the smallest node reachable.

    Each step is written to the shared folder; the loop ends when the edges are stars around smallest
    nodes, which takes a number of steps that is logarithmic in the longest path, none if they are stars at
    first. A node with any number of edges is aggregated before the shuffle, and its join is one that Spark
    splits when skewed.
    """
    at = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .distinct(), "edges")
    while not _stars(at):
        before, at = at, written(_small_star(_large_star(at)), "stars")
        release(before)
    low = at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(low)
