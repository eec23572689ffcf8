"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaline.session import cut


def _star(links: DataFrame) -> DataFrame:
    """node, least: the smallest of a node and its neighbours."""
    return links.groupBy("node").agg(F.min("near").alias("low")).select("node", F.least("node", "low").alias("least"))


def components(links: DataFrame) -> DataFrame:
    """node, component for every node of `links` (columns a, b); the component is its smallest node.

    Each round is two groupings and two joins on nodes; what a hot node has is a plain skewed join. Rounds
    are written to the checkpoint folder and end when a round changes nothing, after about the logarithm of
    the longest path; the number of rounds is all the driver sees.
    """
    links = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        both = links.select(F.col("a").alias("node"), F.col("b").alias("near")).unionAll(
            links.select(F.col("b").alias("node"), F.col("a").alias("near"))
        )
        # large star: larger neighbours are linked to the smallest neighbour
        large = both.where("near > node").join(_star(both), "node").select(F.col("near").alias("node"), F.col("least").alias("near"))
        large = cut(large.where("node <> near").distinct())
        # small star: smaller neighbours and the node itself are linked to the smallest one
        low = _star(large)
        small = large.join(low, "node").select(F.col("near").alias("a"), F.col("least").alias("b"))
        small = small.unionAll(low.select(F.col("node").alias("a"), F.col("least").alias("b")))
        links = cut(small.where("a <> b").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
