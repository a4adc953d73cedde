"""Distributed connected components by alternating star contractions.

Each round replaces, for every node, the links to larger neighbours (large star) and then to smaller
ones (small star) by links to the smallest neighbour; the links shrink to one star per component.
Minima are taken by groupBy with partial aggregation and meet the links in a join that adaptive
execution can split, so a node with very many links doesn't land in one task. Nothing is collected
but a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import cut


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b) of one comparable type; returns (node, root) for nodes with a link, root the least node."""
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(links)
    for _ in range(rounds):
        if not state[0]:
            break
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        links = cut(small.distinct())
        now = _state(links)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v"), F.col("v")).distinct())


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % 1_000_003).cast("long"))).first())
