"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _mark(edges: DataFrame) -> tuple:
    """Tells whether two edge tables differ, from two numbers."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _least(edges: DataFrame) -> DataFrame:
    """(a, m): smallest neighbour of each node, stored: a join against a stored table is cut where a node is hot."""
    return written(edges.groupBy("a").agg(F.min("b").alias("m")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to its smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them."""
    least = _least(edges)
    tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b) of longs; root is the smallest node reached.

    Sums are taken before shuffles. Edges and smallest neighbours are stored before they meet, so adaptive execution
    deals the edges of a much-linked node to several tasks, and a lost executor costs one step at most.
    The number of rounds grows with the logarithm of the longest path. Loops and nulls are ignored.
    """
    now = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now, "edges")
    mark = _mark(now)
    while True:
        large = written(_large_star(now).distinct(), "edges")
        now = written(_small_star(large), "edges")
        new = _mark(now)
        if new == mark:
            break
        mark = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
