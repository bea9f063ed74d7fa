"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import cut_lineage


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``; root is the smallest node of its component.

    Each round hangs the larger neighbours of every node, then the node itself, on its smallest neighbour; the
    smallest neighbour is an aggregate, so a node with very many links never meets in one task. Rounds grow with the
    logarithm of the longest chain. Links of a node with itself are ignored; no links give no rows.
    """
    edges = cut_lineage(links.filter("a <> b").select("a", "b"))
    last = None
    while True:
        both = _both_ways(edges)
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        large = cut_lineage(large.filter("a <> b").distinct())
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = cut_lineage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).cast("string")
        ).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
