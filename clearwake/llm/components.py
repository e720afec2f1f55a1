"""Connected components of an edge table, by stars that grow and shrink in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearwake.session import cut_lineage

#: Edges of one partition; fewer are worked on in one task, without any shuffle.
PART_EDGES = 200_000


def _pairs(*pairs: tuple[str, str]) -> F.Column:
    return F.inline(F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs)))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node in ``edges`` (``a, b``); a component's name is its smallest node.

    Each round links neighbours to the smallest node around (first the larger neighbours, then the smaller ones)
    until nothing changes. Rounds grow with the logarithm of the size.
    """
    current = cut_lineage(edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct())
    seen = None
    while True:
        state = tuple(current.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())
        # a table of one partition is grouped and joined where it lies
        current = current.coalesce(-(-max(1, state[0]) // PART_EDGES))
        if seen == state or not state[0]:
            break
        seen = state
        both = current.select(_pairs(("a", "b"), ("b", "a")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        # every edge leads from a node to a smaller one
        lowest = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(lowest, "a").select(_pairs(("b", "least"), ("a", "least")))
        current = cut_lineage(small.where(F.col("a") != F.col("b")).distinct())
    # each node has one edge now, to its component's name
    return current.select(_pairs(("a", "b"), ("b", "b"))).distinct().select(
        F.col("a").alias("node"), F.col("b").alias("component")
    )
