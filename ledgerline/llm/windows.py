"""Repeated windows of a fixed length, found from content-defined anchors.

Every window of L units (bytes or words) is assigned to one anchor inside it, chosen
from the window's content alone, so equal windows have equal anchors at equal
offsets.  Consecutive windows with one anchor form a run, with
fingerprints: a ``key`` of the anchor's context, which lies in every window of the
run, and ``seg`` of all the text that the run covers.  A key may be several names,
of stretches that double in length; anchors are then ranked by them in rounds.  Only
(key, seg, document) is shuffled, a small share of the text:

1. runs with equal (key, seg) are equal throughout and are settled as one class;
2. where classes share a key without being equal, one document of each class shows
   stretches of ``group`` windows: one whose common text (the core) is unique is
   dropped, one whose whole text (the hull) is repeated is settled;
3. the single windows of the stretches still open are compared;
4. each document gets back the fingerprints that are repeated in it, and cuts.

Ranks are fingerprints of 64 bits each; a class and a window are told by two of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Documents whose ids are broadcast when their texts are fetched; beyond, a shuffle.
FETCH_IDS = 2_000_000
#: Keys from here on are no ids: each stands for a row without one, and counts as the same, latest document.
NO_ID = (1 << 63) - (1 << 40)


@dataclass
class Block:
    """Units of some rows: their hash prefixes, and the first unit of each row."""

    h1: np.ndarray
    h2: np.ndarray
    offsets: np.ndarray
    first: int
    extra: tuple = ()


@dataclass
class Scheme:
    """length: units of a window; blocks(column): Blocks; anchors(block, n): anchor position of each window start and the names of its context."""

    length: int
    blocks: Callable
    anchors: Callable
    #: Windows of a stretch; 1: single windows at once.
    group: int = 1
    #: Names that make up a key: of the first units behind an anchor, of as many at that offset, of as many at twice that offset and so on.
    names: int = 1


def address(doc_id: str = "doc_id", text: str = "text", earlier: bool = True):
    """Key by which a row gets back what is repeated in it.

    Where the order of ids counts it is the id, and for rows without one a key of their
    text above all ids, so that they are not sent to one task; an id as large as these
    keys counts as none.  Else it is the row's own key.
    """
    if not earlier:
        return common.row_key(doc_id, text)
    none = F.lit(NO_ID) + F.pmod(F.xxhash64(text), F.lit(1 << 39))
    doc = F.col(doc_id).cast("long")
    return F.when(doc < NO_ID, doc).otherwise(none)


def _as_document(key):
    """The document that a key stands for, in the order of documents."""
    return F.least(F.col(key) if isinstance(key, str) else key, F.lit(NO_ID))


def fold_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i that has so many, in three passes."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    pad = np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)
    rows = np.concatenate((x, pad)).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs(block: Block, scheme: Scheme):
    """(row, first window, windows, anchor, key, seg) of each run of a block; a key has a column for each name."""
    n = len(block.h1) - 1 - scheme.length + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, empty, np.zeros((0, scheme.names), np.uint64), empty.astype(np.uint64)
    row = np.searchsorted(block.offsets, np.arange(n), "right") - 1
    inside = np.arange(n) + scheme.length <= block.offsets[row + 1]
    at, key = scheme.anchors(block, n)
    at = np.where(inside, at, -1)
    edge = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (row[1:] != row[:-1]))))
    size = np.diff(np.append(edge, n))
    keep = at[edge] >= 0
    edge, size = edge[keep], size[keep]
    seg = common.span_hash(block.h2, edge, edge + size - 1 + scheme.length)
    with np.errstate(over="ignore"):
        seg = common.mix(seg + (at[edge] - edge).astype(np.uint64) * common.BASE + size.astype(np.uint64))
    return row[edge], edge, size, at[edge], key(at[edge]).reshape(-1, scheme.names), seg


def stretches(block: Block, scheme: Scheme, first: np.ndarray, size: np.ndarray, at: np.ndarray):
    """(run, number, first window, last window, core, hull, whole) of each stretch of the given runs.

    Stretch k holds the windows that begin k * group to k * group + group - 1 units
    before the anchor; whole: the run has them all, else the hull means nothing.
    """
    g, length = scheme.group, scheme.length
    last = first + size - 1
    low, high = (at - last) // g, (at - first) // g
    n = high - low + 1
    run = np.repeat(np.arange(len(first)), n)
    k = low[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    end = at[run] - k * g
    begin = end - g + 1
    whole = (begin >= first[run]) & (end <= last[run])
    with np.errstate(over="ignore"):
        salt = common.mix(k.astype(np.uint64) + np.uint64(1))
        core = common.mix(common.span_hash(block.h2, end, begin + length) + salt)
        hull = common.mix(common.span_hash(block.h2, np.where(whole, begin, 0), np.where(whole, end + length, 0)) ^ salt)
    return run, k, np.maximum(begin, first[run]), np.minimum(end, last[run]), core, hull, whole


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _key(scheme: Scheme) -> list[str]:
    return [f"key{i}" for i in range(scheme.names)]


def _parsed(docs: DataFrame, scheme: Scheme, keys: bool, earlier: bool) -> DataFrame:
    """(key0.., seg, doc, last, n): runs with the least and greatest document and the count, combined within a batch.

    Without keys: (seg, doc), the distinct runs of each document.
    """
    names = [*_key(scheme), "seg", "doc", "last", "n"] if keys else ["seg", "doc"]

    def run(batches):
        for b in batches:
            ids, found = b.column(0).to_numpy(), []
            for block in scheme.blocks(b.column(1)):
                row, _, _, _, key, seg = runs(block, scheme)
                if len(row):
                    found.append((key, seg, ids[block.first + row]))
            if not found:
                continue
            key, seg, doc = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((doc, *key.T, seg) if keys else (seg, doc))
            key, seg, doc = key[order], seg[order], doc[order]
            same = (seg[1:] == seg[:-1]) & ((key[1:] == key[:-1]).all(axis=1) if keys else (doc[1:] == doc[:-1]))
            new = np.flatnonzero(np.concatenate(([True], ~same)))
            if not keys:
                yield pa.RecordBatch.from_arrays([_long(seg[new]), pa.array(doc[new])], names=names)
                continue
            end = np.append(new[1:], len(seg))
            yield pa.RecordBatch.from_arrays([*(_long(k[new]) for k in key.T), _long(seg[new]), pa.array(doc[new]), pa.array(np.minimum(doc[end - 1], NO_ID) if earlier else doc[end - 1]), pa.array((end - new).astype(np.int64))], names=names)

    return docs.select("doc", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _doubled(parsed: DataFrame, key: list[str], earlier: bool) -> DataFrame:
    """Prefix doubling over the anchors: in each round the rank of an anchor is paired with the rank at the offset that it covers, pairs are sorted, and an anchor whose pair is unique is dropped.

    The names of a key are the ranks at offsets 0, 1, 2, 4, ... (in units of the first
    one), so the rank after a round is the tuple of the names so far.  One exchange by
    the first pair serves all rounds.
    """
    for covered_ in range(2, len(key) + 1):
        pair = Window.partitionBy(*key[:covered_])
        if earlier:
            parsed = parsed.withColumn("low", _as_document(F.min("doc").over(pair))).withColumn("high", F.max("last").over(pair)).where("low < high").drop("low", "high")
        else:
            parsed = parsed.withColumn("times", F.sum("n").over(pair)).where("times > 1").drop("times")
    return parsed


def _shown(docs: DataFrame, wanted: DataFrame, scheme: Scheme, single: bool, by_doc: bool) -> DataFrame:
    """Of the runs in wanted (doc, seg): (core, hull, own, k) of their stretches, hull null if incomplete; or (window, second, own) of single windows.

    own is the document or the run; with a column k in wanted, only those stretches show their windows.
    """
    ids = wanted.select("doc").distinct()
    texts = docs.select("doc", "text").join(F.broadcast(ids) if ids.count() <= FETCH_IDS else ids, "doc", "left_semi")
    some = "k" in wanted.columns
    lists = wanted.groupBy("doc").agg(F.collect_set(F.struct("seg", F.col("k") if some else F.lit(0).alias("k"))).alias("w"))
    asked = texts.join(lists, "doc").select("doc", "text", F.col("w.seg").alias("segs"), F.col("w.k").alias("ks"))

    def run(batches):
        for b in batches:
            ids, segs, ks = b.column(0).to_numpy(), b.column(2), b.column(3)
            for block in scheme.blocks(b.column(1)):
                row, first, size, at, _, seg = runs(block, scheme)
                seg = seg.view(np.int64)
                bounds = np.searchsorted(row, np.arange(len(block.offsets)))
                picked = []
                for r in range(len(block.offsets) - 1):
                    lo, hi = bounds[r], bounds[r + 1]
                    hit = lo + np.flatnonzero(np.isin(seg[lo:hi], segs[block.first + r].values.to_numpy())) if hi > lo else np.zeros(0, np.int64)
                    picked.append(hit[np.unique(seg[hit], return_index=True)[1]])
                mine = np.concatenate(picked)
                if not len(mine):
                    continue
                doc = ids[block.first + row[mine]]
                own = doc if by_doc else seg[mine]
                if single and not some:
                    n = size[mine]
                    of = np.repeat(np.arange(len(mine)), n)
                    begin = first[mine][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                else:
                    of, k, low, high, core, hull, whole = stretches(block, scheme, first[mine], size[mine], at[mine])
                    if not single:
                        yield pa.RecordBatch.from_arrays([_long(core), pa.array(hull.view(np.int64), mask=~whole), pa.array(own[of]), pa.array(doc[of]), pa.array(seg[mine][of]), pa.array(k.astype(np.int32))], names=["core", "hull", "own", "doc", "seg", "k"])
                        continue
                    # the stretches asked for, told by run and number
                    asked = [np.column_stack((segs[i].values.to_numpy(), ks[i].values.to_numpy().astype(np.int64))) for i in block.first + np.unique(row[mine])]
                    pair = np.rec.fromarrays(np.concatenate(asked).T)
                    keep = np.isin(np.rec.fromarrays((seg[mine][of], k.astype(np.int64))), pair)
                    of, low, high = of[keep], low[keep], high[keep]
                    n = high - low + 1
                    begin = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    of = np.repeat(of, n)
                yield pa.RecordBatch.from_arrays([*(_long(common.span_hash(h, begin, begin + scheme.length)) for h in (block.h2, block.h1)), pa.array(own[of])], names=["window", "second", "own"])

    return asked.mapInArrow(run, "window long, second long, own long" if single else "core long, hull long, own long, doc long, seg long, k int")


def _lists(rows: DataFrame, name: str) -> DataFrame:
    return common.checkpointed(rows.groupBy("doc").agg(F.collect_set(name).alias(f"{name}s")))


def repeated(docs: DataFrame, scheme: Scheme, earlier: bool) -> DataFrame:
    """docs (doc, text, and more) with ``segs``, ``hulls`` and ``windows``: fingerprints of its runs, stretches and windows that are repeated.

    earlier: only a window that also starts in a document with a smaller id counts;
    else any second start counts, in the same document too.
    """
    # where the order of documents counts, rows without an id are one document
    own = _as_document("own") if earlier else F.col("own")
    # one exchange by key serves the classes and what is known of their keys
    parsed = _parsed(docs, scheme, True, earlier)
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = _key(scheme)
    ranked = _doubled(parsed.repartition(parts, *key[:2]), key, earlier)
    classes = ranked.groupBy(*key, "seg").agg(F.sum("n").alias("n"), F.min("doc").alias("doc"), F.max("last").alias("last"))
    of_key = Window.partitionBy(*key)
    known = classes.withColumn("classes", F.count("*").over(of_key))
    if earlier:
        known = known.withColumn("least", _as_document(F.min("doc").over(of_key))).withColumn("most", F.max("last").over(of_key)).where("least < most")
        known = known.select("seg", "doc", (_as_document("doc") < F.col("last")).alias("whole"), (F.col("classes") > 1).alias("open"))
    else:
        known = known.where((F.col("classes") > 1) | (F.col("n") > 1)).select("seg", "doc", (F.col("n") > 1).alias("whole"), (F.col("classes") > 1).alias("open"))
    known = common.checkpointed(known)
    common.release(docs)
    held = _parsed(docs, scheme, False, earlier).join(known.where("whole").select("seg", F.col("doc").alias("least")), "seg")
    segs = _lists(held.where("doc > least") if earlier else held, "seg")
    common.release(docs)
    # a class alone in its key is settled; of the others one document each shows its windows
    open_ = known.where("open").select("doc", "seg")
    if scheme.group == 1:
        shown = common.checkpointed(_shown(docs, open_, scheme, single=True, by_doc=earlier))
        hulls = None
    else:
        part = common.checkpointed(_shown(docs, open_, scheme, single=False, by_doc=earlier))
        cores = part.groupBy("core").agg(F.min(own).alias("low"), F.max(own).alias("high")).where("low < high").select("core")
        part = common.checkpointed(part.join(cores, "core", "left_semi"))
        common.release(docs)
        whole = part.where("hull is not null").groupBy("hull").agg(F.min(own).alias("low"), F.max(own).alias("high")).where("low < high").select("hull", "low")
        told = part.join(whole, "hull", "left").withColumn("settled", F.col("low").isNotNull())
        told = common.checkpointed(told.withColumn("mine", F.col("settled") & (F.col("own") > F.col("low") if earlier else F.lit(True))))
        hulls = _lists(told.where("mine").select("doc", "hull"), "hull")
        # an open stretch is compared with every stretch of its core
        left = told.where("not mine" if earlier else "not settled").select("core").distinct()
        shown = common.checkpointed(_shown(docs, told.join(left, "core", "left_semi").select("doc", "seg", "k"), scheme, single=True, by_doc=earlier))
    common.release(docs)
    twice = shown.groupBy("window", "second").agg(F.min(own).alias("low"), F.max(own).alias("high")).where("low < high").select("window", "second", "low")
    mine = shown.join(twice, ["window", "second"])
    mine = mine.where("own > low").select(F.col("own").alias("doc"), "window") if earlier else mine.select(F.col("own").alias("seg"), "window").join(open_, "seg")
    windows = _lists(mine.select("doc", "window"), "window")
    common.release(docs)
    sent = segs.join(windows, "doc", "full_outer")
    sent = sent.join(hulls, "doc", "full_outer") if hulls is not None else sent.withColumn("hulls", F.lit(None).cast("array<bigint>"))
    # only texts with something to cut are shuffled, as long as their keys can be broadcast
    sent = common.checkpointed(sent)
    ids = sent.select("doc").distinct()
    if ids.count() > FETCH_IDS:
        return docs.join(sent, "doc", "left")
    none = F.lit(None).cast("array<bigint>")
    rest = docs.join(F.broadcast(ids), "doc", "left_anti").select("*", *(none.alias(c) for c in ("segs", "windows", "hulls")))
    return docs.join(F.broadcast(ids), "doc", "left_semi").join(sent, "doc").select(*rest.columns).unionByName(rest)


def covered(block: Block, scheme: Scheme, segs: pa.Array, hulls: pa.Array, windows: pa.Array) -> np.ndarray:
    """For each unit of a block whether a repeated window covers it; what is repeated comes by row of the batch."""
    change = np.zeros(len(block.h1), np.int32)

    def mark(first, last):
        np.add.at(change, first, 1)
        np.add.at(change, last + scheme.length, -1)

    row, first, size, at, _, seg = runs(block, scheme)
    seg = seg.view(np.int64)
    bounds = np.searchsorted(row, np.arange(len(block.offsets)))
    for r in range(len(block.offsets) - 1):
        a, b = bounds[r], bounds[r + 1]
        i = block.first + r
        if a == b:
            continue
        if segs[i].is_valid:
            hit = a + np.flatnonzero(np.isin(seg[a:b], segs[i].values.to_numpy()))
            mark(first[hit], first[hit] + size[hit] - 1)
        if hulls[i].is_valid:
            _, _, low, high, _, hull, whole = stretches(block, scheme, first[a:b], size[a:b], at[a:b])
            hit = whole & np.isin(hull.view(np.int64), hulls[i].values.to_numpy())
            mark(low[hit], high[hit])
        if windows[i].is_valid:
            begin = np.arange(block.offsets[r], block.offsets[r + 1] - scheme.length + 1)
            begin = begin[np.isin(common.span_hash(block.h2, begin, begin + scheme.length).view(np.int64), windows[i].values.to_numpy())]
            mark(begin, begin)
    return np.cumsum(change[:-1]) > 0
