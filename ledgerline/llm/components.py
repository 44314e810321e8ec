"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, release

#: Edges up to which the least neighbours of all nodes are broadcast; beyond, a shuffle.
BROADCAST_EDGES = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Each round replaces edges by edges to smaller nodes, so that components become
    stars; minima are combined before the shuffle, and a checkpoint a round bounds
    the lineage.  Rounds go on until nothing changes (about log n of them).  The edges
    of a hub stay where they are as long as the minima can be broadcast.
    """
    e = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last, size = None, e.count()
    while size:
        sent = F.broadcast if size <= BROADCAST_EDGES else lambda low: low
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(sent(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sent(low), "u")
        small = small.select("v", "m").unionByName(small.select(F.col("u").alias("v"), "m")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        e = checkpointed(small)
        del both, low, large, small
        release(edges)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last, size = now, now[0]
    stars = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
