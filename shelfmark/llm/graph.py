"""Connected components of links between whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, name: str) -> DataFrame:
    """Link the larger of each node's neighbours to the smallest node around it.

    Edges are (a, b); nodes with very many neighbours are joined against a written table, so
    the join may be split.
    """
    least = materialise(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")),
                        f"{name}-least")
    return (edges.join(least, "a").filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("least").alias("b")))


def components(edges: DataFrame, name: str) -> DataFrame:
    """`node, component` (the smallest node reachable) for every node with an edge (a, b).

    Alternates two star steps until every component is a star around its smallest node: first
    every node's larger neighbours, then its smaller neighbours and itself, move to its smallest
    neighbour. Only two numbers per round come to the driver.
    """
    edges = materialise(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-links")
    seen = None
    turn = 0
    while True:
        turn += 1
        large = materialise(_star(_both_ways(edges), f"{name}-{turn}").distinct(),
                            f"{name}-large-{turn}")
        # Every edge now leads from a larger to a smaller node.
        least = materialise(large.groupBy("a").agg(F.min("b").alias("least")),
                            f"{name}-small-least-{turn}")
        moved = large.join(least, "a")
        small = moved.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = materialise(small.unionByName(
            least.select("a", F.col("least").alias("b"))).filter("a > b").distinct(),
            f"{name}-small-{turn}")
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (state.n, state.x) == seen:
            break
        seen = (state.n, state.x)
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
