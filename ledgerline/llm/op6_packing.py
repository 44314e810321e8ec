"""Conflict-constrained best-fit packing of documents into fixed-size bins.

A document is cut into pieces of at most ``capacity`` words; full pieces fill bins
of their own, the last piece is placed by best fit.  Bins are kept in order of
their residual room and carry two bitmaps, of the sources and of the duplicate
clusters they hold.  A piece goes to the tightest bin that has room and neither
its source nor its cluster: the search starts at the first bin with room enough
and follows successors until one is compatible, without a limit; else a bin opens.

Pieces are dealt to shards of about SHARD rows by a hash of the document and of the
number of its copy, so a hot source, cluster or row is spread evenly; bins never cross shards.  Within a shard,
pieces are taken by falling length, then id.  Only lengths and keys are shuffled.

Defined cases: documents without words (null, empty) take no room and are in no
bin; a null source or cluster conflicts with nothing; repeated rows are packed
each, but never into one bin (they are one cluster); an empty table gives no row;
further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY, SHARD = 2048, 4096


class Bins:
    """Open bins in order of (residual, number), each with its bitmaps."""

    def __init__(self):
        self.order: list[tuple[int, int]] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, size: int, source: int, cluster: int, capacity: int) -> int:
        """Number of the bin that takes the piece; source and cluster are bits, 0 for none."""
        at = bisect_left(self.order, (size, -1))
        while at < len(self.order):
            room, number = self.order[at]
            if not (self.sources[number] & source or self.clusters[number] & cluster):
                del self.order[at]
                break
            at += 1
        else:
            room, number = capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[number] |= source
        self.clusters[number] |= cluster
        if room > size:
            insort(self.order, (room - size, number))
        return number


def pack_shard(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pieces of one shard: shard, bin, doc_id, start, n_words (word offsets in the document)."""
    rows = rows.sort_values(["n_words", "doc_id"], ascending=[False, True], kind="stable", na_position="last")
    bins, out, full = Bins(), [], 0
    bits: list[dict] = [{}, {}]
    common_clusters = rows["cluster"].value_counts()
    shared = set(common_clusters.index[common_clusters > 1])
    tails = []
    for shard, doc, n, source, cluster in zip(rows["shard"], rows["doc_id"], rows["n_words"], rows["source"], rows["cluster"], strict=True):
        whole = n - n % capacity if n > capacity else (n if n == capacity else 0)
        for start in range(0, whole, capacity):
            full += 1
            out.append((shard, -full, doc, start, capacity))
        if n > whole:
            tails.append((n - whole, shard, doc, whole, source, cluster))
    tails.sort(key=lambda t: -t[0])
    for size, shard, doc, start, source, cluster in tails:
        one = 0 if pd.isna(source) else 1 << bits[0].setdefault(source, len(bits[0]))
        two = 0 if pd.isna(cluster) or cluster not in shared else 1 << bits[1].setdefault(cluster, len(bits[1]))
        out.append((shard, bins.place(size, one, two, capacity), doc, start, size))
    found = pd.DataFrame(out, columns=["shard", "bin", "doc_id", "start", "n_words"])
    found.loc[found["bin"] < 0, "bin"] = len(bins.sources) - 1 - found["bin"]
    return found


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD) -> DataFrame:
    """(shard, bin, doc_id, start, n_words) for docs (doc_id, text, source), one row a piece.

    A document's cluster is its text with case and spacing folded: copies share it.
    """
    lower = F.lower(F.coalesce("text", F.lit("")))
    folded = F.trim(F.regexp_replace(lower, r"[\x20\x09-\x0D]+", " "))
    n = F.when(folded == "", 0).otherwise(F.length(folded) - F.length(F.replace(folded, F.lit(" "))) + 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.cast("long").alias("n_words"), F.xxhash64(F.col("source")).alias("source"), F.xxhash64(folded).alias("cluster"), F.col("source").isNull().alias("none"))
    shards = max(1, -(-docs.count() // shard_rows))
    rows = rows.where("n_words > 0").withColumn("source", F.when(~F.col("none"), F.col("source"))).drop("none")
    # repeated rows are numbered, so that they are dealt over the shards too
    same = ["doc_id", "n_words", "source", "cluster"]
    rows = rows.groupBy(*same).agg(F.count("*").alias("copies")).select(*same, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "copy"), F.lit(shards)).cast("int")).drop("copy")
    schema = "shard int, bin long, doc_id long, start long, n_words long"
    return rows.groupBy("shard").applyInPandas(lambda x: pack_shard(x, capacity), schema)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
