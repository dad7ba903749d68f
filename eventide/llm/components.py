"""Connected components by joins: large-star and small-star in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.store import settle


def _star(edges: DataFrame, upward: bool, rows: int) -> DataFrame:
    """Hang the larger (``upward``) or smaller neighbours of each node on its least neighbour.

    ``rows`` is the most nodes there can be.
    """
    if upward:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    if upward:
        # Written, so that the join starts from files and a node with very many neighbours can be split.
        least = settle(least, rows)
    to = F.least("u", "m")
    joined = around.join(least, "u").withColumn("to", to)
    if upward:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("to").alias("v"))
    else:
        moved = joined.filter(F.col("v") != F.col("to")).select(
            F.col("v").alias("u"), F.col("to").alias("v")
        ).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") > F.col("v"))


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, label) for every node of (a, b) links but each component's least, its label.

    The two steps keep every component connected and shorten it; a component of n nodes is a star
    after some log(n) rounds. Nothing leaves the cluster but one sum per round.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .filter(F.col("u") > F.col("v")).distinct())
    state = [F.count("*").alias("edges"), F.bit_xor(F.xxhash64("u", "v")).alias("mark")]
    mark = edges.agg(*state).first()
    for _ in range(most):
        # A step never adds edges.
        edges = settle(
            _star(_star(edges, True, 2 * mark.edges), False, 2 * mark.edges).distinct(), mark.edges)
        now = edges.agg(*state).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        mark = now
    raise RuntimeError(f"components not settled after {most} rounds")
