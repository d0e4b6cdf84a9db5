"""Connected components of a graph kept as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.session import materialise


def _are_stars(edges: DataFrame) -> bool:
    """Whether each a has one edge and no b is an a."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("end"))
    ups = ends.groupBy("end.node").agg(F.sum("end.up").alias("ups"), F.min("end.up").alias("least"))
    return ups.where("ups > 1 or ups > least").count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge, but the roots; the root is the smallest node reachable.

    ``edges`` has columns a and b.  Alternating large-star and small-star steps turn each component into a star
    around its smallest node; a step is one aggregation with map-side combine and one join, so a hub is a skewed
    join side that can be split, never a collected group.  Edges lead from a to a smaller b throughout, so stars are
    told without one more round.  Null ends and loops are ignored; no edges give no rows.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(edges):
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "b")
        large = edges.join(least, "b").select("a", F.col("m").alias("b"))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialise(small.select("e.*").where("a <> b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
