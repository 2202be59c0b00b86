"""Distributed connected components: alternating large-star and small-star rounds, each written to the shared folder.

Rounds go on until every edge leads to a smallest node; their number grows with the logarithm of the nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logfold.llm.common import discard, stored


#: Edges in a file of a round's result, and files at least.
PART_EDGES = 2_000_000
LEAST_PARTS = 8


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _smallest(both).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = _smallest(edges)
    near = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.withColumnRenamed("m", "b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether all edges lead straight to a component's smallest node: every node but those is an ``a`` once, and never a b."""
    nodes = edges.select(F.col("a").alias("n")).unionByName(edges.select(F.col("b").alias("n")).distinct())
    return nodes.groupBy("n").count().where("count > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of the undirected edges a, b.

    Joins on a node, not windows, so that the optimizer can split a node of very high degree. Loops and nulls count
    for nothing; repeated edges are one. No edges: no rows.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", "snappy")
    parts = max(LEAST_PARTS, -(-now.count() // PART_EDGES))  # few files for few edges; a round never adds edges
    while not _settled(now):
        after = stored(_small_star(_large_star(now)).coalesce(parts), "edges", "snappy")
        discard(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
