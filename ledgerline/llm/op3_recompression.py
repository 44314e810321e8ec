"""Removal of repeated word windows by recompression.

Recompression names equal things equally in rounds.  Words are named by
fingerprint; a round parts the symbols into left and right ones by a bit of their
name and replaces each left symbol followed by a right one by the name of the
pair.  Whether two symbols pair depends on them alone, so equal word sequences get
equal symbols inside, but for at most REACH words at either end; runs of one
symbol never pair and stay in step.  After two rounds a symbol spans at most four
words.  Every window takes, of the symbols that lie REACH words inside it, the one
with the least name; that symbol with REACH words about it is the window's anchor,
and documents that share anchors are compared and verified run by run.

Names are global because they are fingerprints: no exchange is needed to agree.  Two
rounds are all that a window of 13 words can use: a third would give symbols of up to
eight words that are sure only seven words inside, and no window is sure to hold one.

Defined cases: null and empty texts have no words; texts of fewer words than a
window keep all; equal windows within one document, or in rows of one id, are no
repeats; rows without an id come after all others and are no earlier document, not
of each other either; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .windows import Block, Scheme, address, covered, repeated

WINDOW, REACH = 13, 3
#: Words of a text that are looked at together; an anchor's place must fit into 21 bits.
PIECE = 1 << 20


def _blocks(window: int):
    def blocks(column: pa.Array):
        """Blocks of rows; a longer text in pieces that share window - 1 words, extra: (bytes, starts, ends, names, row, first word)."""
        data, offsets = common.arrow_bytes(column)
        classes = common.space_classes()
        for a, b in common.blocks(offsets, 1 << 20):
            part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            s, e, row = common.tokens(part, own, classes)
            w, w2 = common.token_hashes(part, s, e, 21), common.token_hashes(part, s, e, 22)
            if b == a + 1 and len(s) > PIECE:
                for at in range(0, len(s) - window + 1, PIECE):
                    to = min(len(s), at + PIECE + window - 1)
                    yield Block(common.prefix_hash(w[at:to]), common.prefix_hash(w2[at:to]), np.array([0, to - at]), a, (part, s[at:to], e[at:to], w[at:to], row[at:to], at))
                continue
            bounds = np.searchsorted(row, np.arange(b - a + 1))
            yield Block(common.prefix_hash(w), common.prefix_hash(w2), bounds, a, (part, s, e, w, row, 0))

    return blocks


def symbols(names: np.ndarray, row: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(first word, name) of the symbols after so many rounds; none crosses a row."""
    at = np.arange(len(names))
    for k in range(rounds):
        if len(names) < 2:
            break
        right = (common.mix(names ^ np.uint64(0x51ED27 + k)) & np.uint64(1)).astype(bool)
        pair = ~right[:-1] & right[1:] & (row[1:] == row[:-1])
        with np.errstate(over="ignore"):
            named = np.concatenate((np.where(pair, common.mix(names[:-1] * common.BASE + names[1:] + np.uint64(k)), names[:-1]), names[-1:]))
        keep = np.concatenate(([True], ~pair))
        names, at, row = named[keep], at[keep], row[keep]
    return at, names


def _anchors(window: int):
    def anchors(block: Block, n: int):
        w, row = block.extra[3:5]
        at, name = symbols(w, row)
        size = np.diff(np.append(at, len(w)))
        low = np.uint64((1 << 21) - 1)
        none = np.iinfo(np.uint64).max
        value, length = np.full(len(w), none, np.uint64), np.full(len(w), 1 << 30)
        value[at] = (common.mix(name) & ~low) | at.astype(np.uint64)
        length[at] = size
        best = np.full(n, none, np.uint64)
        for o in range(REACH, window - REACH):
            fits = length[o : o + n] <= window - REACH - o
            best = np.minimum(best, np.where(fits, value[o : o + n], none))
        where = np.where(best == none, -1, (best & low).astype(np.int64))
        return where, lambda p: common.span_hash(block.h1, p - REACH, p + length[p] + REACH)

    return anchors


def scheme(window: int = WINDOW) -> Scheme:
    """Windows below 2 * REACH + 7 words may hold no symbol that far inside."""
    if window < 2 * REACH + 7:
        raise ValueError(f"a window needs {2 * REACH + 7} words at least")
    return Scheme(window, _blocks(window), _anchors(window))


def _joined(pieces):
    """(row, bytes, starts, ends, cut) of the pieces of a long text, which share some words."""
    row, part = pieces[0][:2]
    n = max(first + len(s) for _, _, s, _, _, first in pieces)
    start, end, cut = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    for _, _, s, e, c, first in pieces:
        start[first : first + len(s)], end[first : first + len(s)] = s, e
        cut[first : first + len(s)] |= c
    return row, part, start, end, cut


def dedup(docs: DataFrame, window: int = WINDOW, text_out: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for docs (doc_id, text); kept: the words left, joined by a blank."""
    way = scheme(window)
    rows = docs.select("doc_id", address().alias("doc"), "text")
    found = repeated(rows, way, earlier=True)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * text_out

    def kept_bytes(part, s, e) -> bytes:
        """Words with one blank between them."""
        size = e - s + 1
        to = np.cumsum(size)
        at = np.arange(to[-1] if len(to) else 0) - np.repeat(to - size, size) + np.repeat(s, size)
        kept = part[np.minimum(at, len(part) - 1)]
        kept[to - 1] = 32
        return kept[:-1].tobytes()

    def run(batches):
        for b in batches:
            total, removed, digest, texts = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), [], []

            def done(r, part, s, e, cut):
                total[r], removed[r] = len(cut), np.count_nonzero(cut)
                kept = kept_bytes(part, s[~cut], e[~cut])
                digest.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept)

            pieces = []  # of a long text
            for block in way.blocks(b.column(1)):
                part, s, e, _, _, first = block.extra
                cut = covered(block, way, b.column(2), b.column(3), b.column(4))
                if pieces and pieces[0][0] != block.first:
                    done(*_joined(pieces))
                    pieces = []
                if first or (len(block.offsets) == 2 and len(s) > PIECE):
                    pieces.append((block.first, part, s, e, cut, first))
                    continue
                for r in range(len(block.offsets) - 1):
                    lo, hi = block.offsets[r], block.offsets[r + 1]
                    done(block.first + r, part, s[lo:hi], e[lo:hi], cut[lo:hi])
            if pieces:
                done(*_joined(pieces))
            cols = [b.column(0), pa.array(total), pa.array(removed), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(texts, pa.binary()).cast(pa.string())] if text_out else []), names=names)

    schema = docs.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    return found.select("doc_id", "text", "segs", "hulls", "windows").mapInArrow(run, schema.add("kept", "string") if text_out else schema)


def op3_recompression(spark, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"), text_out=False)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d
), s AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS k FROM p
), m AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM s
), g AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM m WHERE least < doc_id
), r AS (
  SELECT doc_id, list(j) AS gone FROM g GROUP BY doc_id
)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(gone, j)), lambda j: w[j]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""
