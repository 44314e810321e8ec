"""Exact top-k inner products by MaxScore over shards.

A vector's components are floored to integers.  A query is a list of terms, one a
dimension; a shard (some thousand vectors of one partition) keeps the least and
greatest value of each dimension, so a term's share of a score lies between known
bounds.  A shard whose bounds cannot lift it to a query's k-th best score so far is
not touched.  Terms are ordered by the width of that share over the queries that are
answered together.  The essential ones are added up for all vectors of the shard, as
one matrix product for a group of queries; as soon as the widths of the rest lift
only few vectors to the k-th best score, the rest are non-essential and are probed
only for the pairs that can still reach it.  The first shard of a partition is kept
small, so that every later one has a k-th best score to beat.  The k best of each
partition are then merged.

Queries go out in waves of bounded size: a wave is broadcast, answered and stored
before the next one is read.  With 1 query in 50 vectors the work grows with the
square of the table whatever the method; only its constant is small here.

Defined cases: null vectors, empty vectors and those holding null or non-finite
components take no part, as queries or candidates; a shorter vector counts as padded with zeros;
repeated rows of an id are candidates each, and as a query the id is answered
once, for its smallest vector; rows of the query's own id are no candidates; ties
go to the smaller id; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Queries of a wave, about.
BLOCK = 16_384
#: Vectors of a partition's first shard and of the others; queries answered together.
FIRST, SHARD, TOGETHER = 512, 8192, 128
#: Terms added up between two prunings of the candidates, and the share of pairs left from which they are probed one by one.
STRIDE, FEW = 16, 0.05
#: Scores beyond are given as this.
LARGEST = (1 << 63) - 1025


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component; unusable vectors and null ids left out."""
    fine = F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    v = F.transform(F.col(embedding), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & (F.size(embedding) > 0) & fine).select(F.col(vec_id).alias("vec_id"), v.alias("v"))


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    n = np.diff(offsets)
    out = np.zeros((len(n), max(width or 0, int(n.max(initial=0)))), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], n)] = flat[offsets[0] : offsets[-1]]
    return out


class Shard:
    """Vectors by dimension, with each dimension's bounds; sums are exact in floating point while they stay below 2**53."""

    def __init__(self, ids: np.ndarray, m: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.lists = ids[order], np.ascontiguousarray(m[order].T)
        self.low, self.high = self.lists.min(axis=1), self.lists.max(axis=1)

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, floors: np.ndarray):
        """(query number, ids, scores) of the k best of the shard that score ``floors`` at least, for queries that have any."""
        d = min(q.shape[1], len(self.lists))
        q, low, high, lists = q[:, :d], self.low[:d], self.high[:d], self.lists[:d]
        kind = self._kind(q, low, high)
        if kind is not np.float64:
            floors = floors - np.abs(floors) * 2.0**-50  # they may have been rounded up
        q, low, high, lists = (x.astype(kind) for x in (q, low, high, lists))
        a, b = q * low, q * high
        least, width = np.minimum(a, b), np.abs(a - b)
        asked = np.flatnonzero(least.sum(axis=1) + width.sum(axis=1) >= floors)
        q, least, width, floors = q[asked], least[asked], width[asked], floors[asked]
        terms = np.argsort(-width.sum(axis=0), kind="stable")
        ahead = np.concatenate((np.cumsum(width[:, terms[::-1]], axis=1)[:, ::-1], np.zeros((len(asked), 1), width.dtype)), axis=1)
        have = np.repeat(least.sum(axis=1)[:, None], len(self.ids), axis=1)
        have[query_ids[asked][:, None] == self.ids] = np.iinfo(np.int64).min  # a row is no candidate of its own id
        row = column = None
        for at in range(0, d, STRIDE):
            now = terms[at : at + STRIDE]
            more = q[:, now]
            have += more @ lists[now] - least[:, now].sum(axis=1)[:, None]
            if at + STRIDE < d:
                alive = have + ahead[:, at + STRIDE][:, None] >= floors[:, None]
                if np.count_nonzero(alive) <= FEW * alive.size:
                    row, column = np.nonzero(alive)
                    score = have[row, column]
                    for t in terms[at + STRIDE :]:
                        score = score + q[row, t] * lists[t, column] - least[row, t]
                    break
        if row is None:
            row, column = np.nonzero(have >= floors[:, None])
            score = have[row, column]
        bounds = np.searchsorted(row, np.arange(len(asked) + 1))
        for i, j in enumerate(asked):
            found, ids = score[bounds[i] : bounds[i + 1]], self.ids[column[bounds[i] : bounds[i + 1]]]
            mine = ids != query_ids[j]
            found, ids = found[mine], ids[mine]
            if len(found) > k:
                best = found >= np.partition(found, len(found) - k)[len(found) - k]
                found, ids = found[best], ids[best]
            order = np.lexsort((ids, -found))[:k]
            if len(order):
                yield j, ids[order], np.clip(found[order], -LARGEST, LARGEST).astype(np.int64)

    @staticmethod
    def _kind(q: np.ndarray, low: np.ndarray, high: np.ndarray):
        """The type in which all sums are exact: floating point below 2**53, else integers, else those of any length."""
        ends = np.abs(np.stack((low, high)).astype(np.float64)).max(initial=0)
        largest = ends * np.abs(q.astype(np.float64)).max(initial=0) * 2 * max(1, len(low))
        return np.float64 if largest < 2.0**53 else np.int64 if largest < 2.0**62 else object


def _shards(batches):
    """Shards of a partition's batches (vec_id, v): a small first one, then large ones."""
    held, n, size = [], 0, FIRST
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= size:
            yield held
            held, n, size = [], 0, SHARD
    if held:
        yield held


def _wave(vectors: DataFrame, asked: DataFrame, k: int):
    """(query_id, rank, vec_id, score) for the queries of one wave, and the broadcast that they hang on."""
    rows = asked.toArrow()
    shared = vectors.sparkSession.sparkContext.broadcast((rows.column("vec_id").to_numpy(), _matrix(rows.column("v")) if len(rows) else np.zeros((0, 0), np.int64)))

    def run(batches):
        query_ids, qs = shared.value
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(query_ids)
        floors = np.full(len(query_ids), float("-inf"))
        for held in _shards(batches):
            width = max(int(np.diff(b.column(1).offsets.to_numpy()).max()) for b in held)
            shard = Shard(np.concatenate([b.column(0).to_numpy() for b in held]), np.concatenate([_matrix(b.column(1), width) for b in held]))
            for at in range(0, len(query_ids), TOGETHER):
                for j, ids, score in shard.search(query_ids[at : at + TOGETHER], qs[at : at + TOGETHER], k, floors[at : at + TOGETHER]):
                    have = best[at + j]
                    ids, score = np.concatenate((have[0], ids)), np.concatenate((have[1], score))
                    order = np.lexsort((ids, -score))[:k]
                    best[at + j] = ids[order], score[order]
                    if len(order) == k:
                        floors[at + j] = score[order[-1]]
        n = [len(x[0]) for x in best]
        cols = [np.repeat(query_ids, n)] + [np.concatenate([x[c] for x in best]) if best else none for c in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    found = vectors.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score long")
    # the k best of the k best: a heap of k structs a query, partial on each side of the shuffle
    best = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    best = best.select("query_id", F.posexplode("best").alias("i", "x"))
    return best.select("query_id", (F.col("i") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score")), shared


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of integer vectors (vec_id, v) for queries of the same form."""
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    n = max(1, -(-queries.count() // max(1, block // 2)))
    if n == 1:
        return _wave(vectors, asked, k)[0]
    out = None
    for i in range(n):
        found, shared = _wave(vectors, asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == i), k)
        found = common.checkpointed(found)
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def op8_topk(spark, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
