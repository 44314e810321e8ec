"""Prefix doubling over every byte position, as published: the plain form of op1.

It is exact and short, and it shuffles every position in every round, 98 times the
text on sf0.01.  It serves as an independent check of the sampled form, and for
corpora that are small against the cluster.

Defined cases: see op1; a text shorter than the length has no position to rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of the first rank, which are the rank itself.
FIRST = 7


def positions(docs: DataFrame, length: int) -> DataFrame:
    """(row, pos, rank): every byte position that FIRST bytes follow, ranked by these bytes; row: a column of docs (row, text)."""

    def run(batches):
        for b in batches:
            data, offsets = common.arrow_bytes(b.column(1))
            for r in range(b.num_rows):
                text = data[offsets[r] : offsets[r + 1]].astype(np.int64)
                n = len(text) - FIRST + 1
                if n <= 0 or len(text) < length:
                    continue
                rank = np.zeros(n, np.int64)
                for k in range(FIRST):
                    rank = rank * 256 + text[k : k + n]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, b.column(0)[r].as_py(), np.int64)), pa.array(np.arange(n)), pa.array(rank)], names=["row", "pos", "rank"])

    return docs.select("row", "text").mapInArrow(run, "row long, pos long, rank long")


def reranked(pairs: DataFrame) -> DataFrame:
    """(row, pos, rank) of pairs (row, pos, rank, next): pairs that occur twice, numbered in their order; others are dropped.

    Distinct pairs are counted before they are sorted, so a pair that is everywhere is one row.
    """
    twice = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).where("n > 1").select("rank", "next")
    parts = max(1, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = twice.repartitionByRange(parts, "rank", "next").sortWithinPartitions("rank", "next").withColumn("new", F.monotonically_increasing_id())
    ordered = common.checkpointed(ordered)  # the numbers are given once
    return pairs.join(ordered, ["rank", "next"]).select("row", "pos", F.col("new").alias("rank"))


def repeated_positions(docs: DataFrame, length: int) -> DataFrame:
    """(row, pos): where a string of ``length`` bytes starts that also starts elsewhere, for docs (row, text); length: FIRST at least."""
    alive, size = common.checkpointed(positions(docs, length)), FIRST
    if size == length:
        return common.checkpointed(reranked(alive.withColumn("next", F.lit(0).cast("long")))).select("row", "pos")
    while size < length:
        # the last offset is shorter, so that both parts together are the length
        offset = min(size, length - size)
        behind = alive.select("row", (F.col("pos") - offset).alias("pos"), F.col("rank").alias("next"))
        # what has a unique string behind it is unique, so an inner join drops it
        alive = common.checkpointed(reranked(alive.join(behind, ["row", "pos"])))
        size += offset
    return alive.select("row", "pos")
