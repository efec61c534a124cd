"""Connected components of links between long keys, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut_lineage


def _stars(links: DataFrame, *, large: bool) -> DataFrame:
    """Tie neighbours to the smallest node around: the larger ones of both directions, or the smaller ones of one."""
    pairs = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    # a node's own smallest neighbour; the minimum is combined before the shuffle, the join splits hot nodes
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = pairs.join(least, "a")
    moved = joined.filter(F.col("b") > F.col("a")) if large else joined.unionByName(least.select("a", F.col("a").alias("b"), "m"))
    return moved.filter(F.col("b") != F.col("m")).select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b long): root is the smallest node reachable.

    Rounds go on until nothing changes; each is written to the shared folder. Self links and repeated links do no harm.
    """
    links = links.filter("a IS NOT NULL AND b IS NOT NULL")
    state = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        state = cut_lineage(_stars(_stars(state, large=True), large=False))
        now = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    nodes = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
