"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.llm.common import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie each larger neighbour of a node to the smallest node it sees."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(least, "u").where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(least.select("u", F.col("low").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(u, v)``; ``root`` is the smallest node of its component.

    Each round is an aggregation and a join, so the links of a very connected node are spread by
    Spark as in any skewed join, and rounds are written to the shared folder. The number of rounds
    follows the logarithm of the longest chain. Loops and repeated links are dropped; an empty
    table has no components.
    """
    edges = settle(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state[0] == 0 or tuple(state) == seen:
            break
        seen = tuple(state)
        edges = settle(_small_star(_large_star(edges)), "stars")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
