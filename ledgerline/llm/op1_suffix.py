"""Exact removal of repeated byte strings by prefix doubling over a sample of positions.

Prefix doubling ranks positions by ever longer prefixes: a position's rank and the
rank of the position behind its prefix are a pair, pairs are sorted and become the
ranks of the next round, and only positions whose rank is not unique go on.

Ranking every byte shuffles 98 times the text (measured, README), so the rounds
run on a content-defined sample, which equal strings share: in every window of
LENGTH bytes the position whose KMER-byte fingerprint is least.  First ranks are the
names of KMER / 4 bytes; two rounds at offsets of KMER / 4 and KMER / 2 lead to KMER
bytes, which lie in every window that the position answers for.  Positions that are
not unique by then are compared by all that they answer for, then by stretches of
GROUP windows, then by single windows, each round with those still open.  Texts
themselves are shuffled once, when the cuts are made.

Defined cases: null and empty texts have no bytes and give 0, 0, 0 and the digest
of nothing; texts shorter than the length keep all; repeated rows are copies of
each other; rows without an id are treated like others; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .windows import Block, Scheme, address, covered, fold_min, repeated

#: Bytes of a string, of the last rank, and windows of a stretch.
LENGTH, KMER, GROUP = 400, 160, 16
CHUNK = 1 << 20


def _blocks(length: int):
    def blocks(column: pa.Array):
        data, offsets = common.arrow_bytes(column)
        values = [common.byte_values(s) for s in (11, 12)]
        for a, b in common.blocks(offsets, CHUNK):
            start, end = int(offsets[a]), int(offsets[b])
            for at in range(start, max(start + 1, end - length + 1), CHUNK) if b == a + 1 else (start,):
                # a longer text in pieces that share length - 1 bytes
                part = data[at : min(end, at + CHUNK + length - 1)] if b == a + 1 else data[at:end]
                own = np.array([0, len(part)]) if b == a + 1 else offsets[a : b + 1] - start
                h = [common.prefix_hash(v[part]) for v in values]
                yield Block(h[0], h[1], own, a, (part, at - start))

    return blocks


def _anchors(length: int, kmer: int):
    def anchors(block: Block, n: int):
        m = len(block.h1) - kmer
        g = common.span_hash(block.h1, np.arange(m), np.arange(m) + kmer)
        low = np.uint64((1 << 21) - 1)
        least = fold_min((g & ~low) | np.arange(m, dtype=np.uint64), length - kmer + 1)
        quarter = kmer // 4
        bounds = (0, quarter, 2 * quarter, kmer)

        def names(at):
            return np.column_stack([common.span_hash(block.h1, at + x, at + y) for x, y in zip(bounds, bounds[1:], strict=False)])

        return (least[:n] & low).astype(np.int64), names

    return anchors


def scheme(length: int = LENGTH, kmer: int = KMER, group: int = GROUP) -> Scheme:
    return Scheme(length, _blocks(length), _anchors(length, kmer), group, names=3)


def dedup(docs: DataFrame, length: int = LENGTH, kmer: int = KMER, text_out: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for docs (doc_id, text); kept: the remaining bytes."""
    way = scheme(length, kmer)
    rows = docs.select("doc_id", address(earlier=False).alias("doc"), "text")
    found = repeated(rows, way, earlier=False)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * text_out

    def run(batches):
        for b in batches:
            n = b.num_rows
            data, offsets = common.arrow_bytes(b.column(1))
            cut = np.zeros(len(data), bool)
            for block in way.blocks(b.column(1)):
                part, shift = block.extra
                at = int(offsets[block.first]) + shift
                cut[at : at + len(part)] |= covered(block, way, b.column(2), b.column(3), b.column(4))
            out = {k: [] for k in names[1:]}
            for r in range(n):
                gone, text = cut[offsets[r] : offsets[r + 1]], data[offsets[r] : offsets[r + 1]]
                kept = text[~gone].tobytes() if gone.any() else text.tobytes()
                out["n_bytes"].append(len(text))
                out["n_removed"].append(len(text) - len(kept))
                out["n_spans"].append(int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].any()))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if text_out:
                    out["kept"].append(kept)
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * text_out
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[k], t) for k, t in zip(names[1:], kinds, strict=True))], names=names)

    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    return found.select("doc_id", "text", "segs", "hulls", "windows").mapInArrow(run, schema.add("kept", "binary") if text_out else schema)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"), text_out=False)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents
), p AS (
  SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS i FROM d
), w AS (
  SELECT doc_id, i, substring(h, 2 * i + 1, 2) AS b, CASE WHEN 2 * i + 800 <= len(h) THEN md5(substring(h, 2 * i + 1, 800)) END AS k FROM p
), c AS (
  SELECT doc_id, i, b, CASE WHEN k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 THEN 1 ELSE 0 END AS again FROM w
), g AS (
  SELECT doc_id, i, b, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS gone FROM c
), r AS (
  SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g
), a AS (
  SELECT doc_id, count(*) AS n, sum(gone) AS removed, sum(CASE WHEN gone = 1 AND before = 0 THEN 1 ELSE 0 END) AS spans,
         coalesce(string_agg(b, '' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept
  FROM r GROUP BY doc_id
)
SELECT d.doc_id AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""
