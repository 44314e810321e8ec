"""Shared pieces: table access, byte-level tokenising and hashing, count-table merging.

Texts are handled as UTF-8 bytes straight from Arrow buffers.  One prefix
polynomial over a block of texts (mod 2**64, odd base) gives the hash of every
token or window in constant time.
"""

from __future__ import annotations

import gc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch sent to a Python worker; bounds its memory with long texts.
ARROW_ROWS = 256
#: Bytes of text hashed at once inside a worker.  A longer text is a block of its own.
BLOCK_BYTES = 2 << 20

BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the cluster's shared checkpoint folder (set here only when unset)."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not shared:
            import tempfile

            shared = tempfile.mkdtemp(prefix="ledgerline-ckpt-")
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Let Spark delete the shuffle and checkpoint files of what is no longer referred to."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def held_out(column, modulus: int, remainder: int):
    """True where crc32 of the id's decimal text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def byte_values(seed: int = 1) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: np.uint64 = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i (mod 2**64) for 0 <= i < n."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = np.full(size, base), np.full(size, inverse)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            have = _POWERS[int(base)] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have[0][:n], have[1][:n]


def prefix_hash(values: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """Running sums so that span(h, s, e) is the hash of values[s:e]."""
    h = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * powers(len(values), base)[0], dtype=np.uint64, out=h[1:])
    return h


def span_hash(h: np.ndarray, s: np.ndarray, e: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((h[e] - h[s]) * powers(len(h), base)[1][s])


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All text bytes of a string column and the offsets of each row; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """(first, last) row ranges holding about ``limit`` bytes, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def space_classes() -> np.ndarray:
    table = np.ones(256, np.uint8)
    table[list(SPACE)] = 0
    return table


def letter_classes() -> np.ndarray:
    """1 for ASCII letters, digits and all bytes of longer code points; 0 otherwise."""
    table = np.zeros(256, np.uint8)
    for lo, hi in ((48, 57), (65, 90), (97, 122), (128, 255)):
        table[lo : hi + 1] = 1
    return table


def run_classes() -> np.ndarray:
    """Lower-case, upper-case, digit and punctuation runs, each a token of its own kind."""
    table = np.full(256, 4, np.uint8)
    table[list(SPACE)] = 0
    table[48:58], table[65:91], table[97:123], table[128:256] = 3, 2, 1, 1
    return table


def tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray):
    """Starts, ends and row numbers of the maximal runs of one non-zero class; none crosses a row."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    kind = classes[data]
    edge = np.empty(len(data), bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(data))
    keep = kind[starts] != 0
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold[data]


def token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    return span_hash(prefix_hash(byte_values(seed)[data]), starts, ends)


def summed_tables(df: DataFrame, partial, size: int, slices: int = 32, fan: int = 16, dtype=np.float64) -> np.ndarray:
    """Sum one table of ``size`` cells over all partitions of ``df``.

    ``partial(batches)`` returns a partition's table (float32 or float64).  Tables travel in compressed
    slices, are merged in two rounds (``fan`` merges a slice, then one) and reach the
    driver once: ``size`` cells, whatever the input.
    """
    width = -(-size // slices)
    schema = "slice int, salt int, cells binary"

    def pack(tables, salt):
        for k, cells in tables:
            yield pa.RecordBatch.from_pydict(
                {"slice": pa.array([k], pa.int32()), "salt": pa.array([salt], pa.int32()), "cells": pa.array([zlib.compress(cells.tobytes(), 1)], pa.binary())}
            )

    def first(batches):
        from pyspark import TaskContext

        cells = partial(batches)
        own = ((k, cells[k * width : (k + 1) * width].astype(np.float64)) for k in range(slices))
        yield from pack(((k, c) for k, c in own if c.any()), TaskContext.get().partitionId() % fan)

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column("slice").to_pylist(), b.column("cells").to_pylist(), strict=True):
                c = np.frombuffer(zlib.decompress(c), np.float64)
                sums[k] = sums[k] + c if k in sums else c
        yield from pack(sums.items(), 0)

    rows = df.mapInArrow(first, schema).repartition(slices * 2, "slice", "salt").mapInArrow(merge, schema)
    rows = rows.repartition(slices, "slice").mapInArrow(merge, schema).collect()
    out = np.zeros(width * slices, dtype)
    for r in rows:
        c = np.frombuffer(zlib.decompress(bytes(r["cells"])), np.float64)
        out[r["slice"] * width : r["slice"] * width + len(c)] += c
    return out[:size]


def revived(kind: type, state: dict):
    """An object of a class of this package from its fields: broadcasts carry fields only, since workers need no copy of the package."""
    out = kind.__new__(kind)
    out.__dict__.update(state)
    return out


def joined_labels(docs: DataFrame, labels: DataFrame, key: str = "doc_id", broadcast_rows: int = 2_000_000) -> DataFrame:
    """Inner join of texts with label rows; labels (a few numbers a row) are broadcast up to a counted size, shuffled beyond."""
    return docs.join(F.broadcast(labels) if labels.count() <= broadcast_rows else labels, key)


def label_sample(labels: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """At most ``limit`` label rows, those with the smallest hash of their id: the same rows whatever the partitions."""
    return labels.orderBy(F.xxhash64(key), *labels.columns).limit(limit)


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """A row's own key, never null: rows with equal id and text are one document, ids may be null or shared."""
    return F.xxhash64(doc_id, text)


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id", broadcast_rows: int = 2_000_000) -> DataFrame:
    """Rows of docs whose id is not in ids (one column of that name); a null id equals a null id."""
    gone = ids.select(F.col(key).alias("_gone"))
    return docs.join(F.broadcast(gone) if gone.count() <= broadcast_rows else gone, docs[key].eqNullSafe(gone["_gone"]), "left_anti")
