"""Connected components by alternating large and small stars, one written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from populi.llm.common import Scratch


def _lowest(edges: DataFrame) -> DataFrame:
    """a, m: the smallest neighbour; partial sums keep a hot node to one row a task."""
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(_lowest(both).select("a", F.least("a", "m").alias("m")), "a")
    return near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    low = _lowest(edges)
    moved = edges.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (the smallest node reachable) of every node that has a link; edges: a, b of one ordered type.

    Links may repeat and point either way; loops are dropped. Rounds are logarithmic in the longest chain; the driver
    sees one checksum a round."""
    e = (edges.where(F.col("a") != F.col("b"))
         .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    e, seen, k = scratch.write(e, "links-0"), None, 0
    while True:
        state = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0)).alias("sum")).first()
        if state == seen or not state["n"]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen, k = state, k + 1
        e = scratch.write(_small_star(_large_star(e).distinct()).distinct(), f"links-{k}")
        scratch.drop(f"links-{k - 1}")
