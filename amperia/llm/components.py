"""Connected components of a graph of document ids, by alternating stars: two joins a round, a logarithmic number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _settled(edges: DataFrame) -> bool:
    """Whether all edges lead from a node to the root of its tree: nothing has two edges down, or one down and one up."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down + up > 1 and down > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node and comp (the smallest node of its component) of every node of edges (a, b). A node with very many edges meets them as a minimum, summed up before the shuffle, and in joins whose large partitions Spark splits."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while not _settled(now):
        both = now.select("a", "b").union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", "m")).distinct()
        now = written(small, "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(now.select("b", "b").distinct())


def merged(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """components (node, comp) with more edges (a, b) added. Only the graph of components is searched."""
    own = lambda end: comps.select(F.col("node").alias(end), F.col("comp").alias(f"comp_{end}"))
    named = edges.join(own("a"), "a", "left").join(own("b"), "b", "left")
    whole = components(named.select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))).toDF("comp", "whole")
    fresh = whole.join(comps.select(F.col("node").alias("comp")), "comp", "left_anti")
    return comps.join(whole, "comp", "left").select("node", F.coalesce("whole", "comp").alias("comp")).union(fresh)
