"""Connected components by alternating large-star and small-star steps, each written to the shared folder.

A step finds every node's smallest neighbour by an aggregate with map-side partial minima and joins it back; a centre with
very many links is pre-aggregated before the shuffle, and in the join its partition can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import drop_staged, stage


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one link down, to a node without any: the links are the components."""
    inner = edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi").select("b")
    twice = edges.groupBy("a").count().where("count > 1").select(F.col("a").alias("b"))
    return inner.unionAll(twice).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = stage(down.groupBy("u").agg(F.min("v").alias("m")), "small")
    sides = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("x"))
    return sides.select("x.a", "x.b").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the smallest node reachable; nodes without links are absent.

    Links may repeat, point either way, or join a node to itself (which says nothing). Without links the result is empty.
    """
    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while not _stars(edges):
        large = stage(_large_star(edges), "links")
        small = stage(_small_star(large), "links")
        drop_staged(edges)
        drop_staged(large)
        edges = small
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
