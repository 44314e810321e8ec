"""Near-duplicate groups by banded MinHash with odd sketches, confirmed on full sets.

A document is the set of its distinct word shingles.  Documents with equal sets
form a class; only class representatives go on.  MinHash samples are banded; the
same samples are folded into an odd sketch, a parity bitmap whose XOR population
count estimates high similarities closely, and pairs far below the threshold are
dropped by it before the full sets are compared.

Buckets are never expanded into all pairs.  Up to SMALL members are compared pair
by pair; a larger bucket is compared with one pivot.  Large buckets that share
members form a group, whose centre c is the pivot with most links.  All members are
compared with c.  Two members of one component need no more, nor do two that are both
linked to c.  For the others
let D(x) be the difference set x ^ c.  Then |x ^ y| = |D(x) ^ D(y)|, and J(x, y) >= t
takes all but |x| (1 - t) / t of D(x); if J(y, c) < t, it takes more than half of
|D(x)| + (|c| - |x|) (1 - t) / (1 + t) too.  In any order that all keep, two such sets
share one of the first |D| - need + 1 shingles of each; a row is cut to these before it
is dealt, those that a sample shows to be frequent last: one linked to c to what a
partner that is not needs (its head), others to what any partner needs, of which the head
meets the others.  What occurs in one component only is dropped, and only members outside
the centre's component meet the others; a pair is not compared if what it shares in front,
with what may lie behind, is too little for a link.  Nothing is capped.

With 32 bands of 4 rows a pair at similarity 0.8 meets in some band but for a
chance of 5e-8, and the sketch passes it but for 1e-8.

Defined cases: texts without words, null and empty ones have no set and link with
nothing; a row without an id only joins the class of its set; rows that share an
id are linked; repeated rows are returned each; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

BANDS, ROWS = 32, 4
#: Sketch bits, and the XOR population count up to which a pair is compared in full
#: (about six standard deviations above the mean at similarity 0.8).
BITS, FAR = 256, 88
SMALL = 16
#: About so many members tell a group's consensus, from which only its centre is chosen.
SAMPLE = 48
#: Documents whose ids are broadcast when their texts are fetched; beyond, a shuffle.
FETCH_IDS = 2_000_000


def shingle_sets(column: pa.Array, width: int):
    """(row, sorted distinct shingle hashes) of each row that has words."""
    data, offsets = common.arrow_bytes(column)
    classes = common.space_classes()
    for a, b in common.blocks(offsets):
        part, own = common.lower_ascii(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
        s, e, row = common.tokens(part, own, classes)
        if not len(s):
            continue
        h = common.token_hashes(part, s, e)
        n = np.bincount(row, minlength=b - a)
        ends = np.cumsum(n)
        with np.errstate(over="ignore"):
            g = h.copy()
            for k in range(1, width):
                g[: len(h) - k] = common.mix(g[: len(h) - k] * common.BASE + h[k:])
        for r in np.flatnonzero(n):
            words = h[ends[r] - n[r] : ends[r]]
            if n[r] < width:  # the whole sequence is one shingle
                one = words[:1]
                with np.errstate(over="ignore"):
                    for x in words[1:]:
                        one = common.mix(one * common.BASE + x)
                yield a + r, one
            else:
                yield a + r, np.unique(g[ends[r] - n[r] : ends[r] - width + 1])


def _multipliers() -> np.ndarray:
    return common.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def signatures(docs: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, f1, f2, bands array<long>, s0..s3): set size, set fingerprint, band keys, odd sketch; one row a document."""
    lanes = BITS // 64
    schema = "doc_id long, n long, f1 long, f2 long, bands array<long>, " + ", ".join(f"s{i} long" for i in range(lanes))

    def fill(ids, sets):
        rows = len(ids)
        n, f1, f2 = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
        bands, bits = np.zeros((rows, BANDS), np.uint64), np.zeros((rows, BITS), np.uint8)
        at = np.array([r for r, _ in sets], np.int64)
        if len(at):
            flat = np.concatenate([x for _, x in sets])
            size = np.array([len(x) for _, x in sets])
            starts = np.concatenate(([0], np.cumsum(size)[:-1]))
            n[at] = size
            with np.errstate(over="ignore"):
                f1[at] = np.add.reduceat(common.mix(flat ^ np.uint64(0x1234567)), starts)
                f2[at] = np.add.reduceat(common.mix(flat * np.uint64(3) + np.uint64(99)), starts)
                key = np.zeros(len(at), np.uint64)
                for i, m in enumerate(_multipliers()):
                    low = np.minimum.reduceat(flat * m, starts)
                    place = common.mix(low + np.uint64(i)) % np.uint64(BITS)
                    bits[at, place.astype(np.int64)] ^= 1
                    key = common.mix((low if i % ROWS == 0 else key * common.BASE + low) + np.uint64(i))
                    if i % ROWS == ROWS - 1:
                        bands[at, i // ROWS] = key
        sketch = np.packbits(bits, axis=1).view(np.int64)
        keys = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).reshape(-1)))
        return pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), keys, *(pa.array(sketch[:, i]) for i in range(lanes))], names=[x.split()[0] for x in schema.split(", ")])

    def run(batches):
        for b in batches:
            done, sets, held = 0, [], 0
            for r, x in shingle_sets(b.column(1), width):
                if held > 1 << 18:  # bounded: the sets of some rows at a time
                    yield fill(b.column(0)[done:r], sets)
                    done, sets, held = r, [], 0
                sets.append((r - done, x))
                held += len(x)
            yield fill(b.column(0)[done:], sets)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, schema)


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles array<long>) of the documents in ids (doc_id)."""

    def run(batches):
        for b in batches:
            rows, sets, held = [], [], 0
            for r, x in shingle_sets(b.column(1), width):
                rows.append(r), sets.append(x)
                held += len(x)
                if held > 1 << 18:
                    yield pack(b, rows, sets)
                    rows, sets, held = [], [], 0
            yield pack(b, rows, sets)

    def pack(b, rows, sets):
        ends = np.concatenate(([0], np.cumsum([len(x) for x in sets], dtype=np.int64))).astype(np.int32)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], names=["doc_id", "shingles"])

    wanted = F.broadcast(ids) if ids.count() <= FETCH_IDS else ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi").mapInArrow(run, "doc_id long, shingles array<long>")


def _bucket_pairs(members: DataFrame) -> DataFrame:
    """(a, b, star) from members (key, rep): all pairs of small buckets, pairs with the smallest member of large ones."""
    size = members.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("pivot")).where("size > 1")
    known = members.join(size, "key")
    small = known.where(f"size <= {SMALL}").select("key", "rep")
    pairs = small.alias("x").join(small.alias("y"), "key").where("x.rep < y.rep").select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.lit(False).alias("star"))
    stars = known.where(f"size > {SMALL} and rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b"), F.lit(True).alias("star"))
    return pairs.unionByName(stars).groupBy("a", "b").agg(F.max("star").alias("star"))


def _stored_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles) of the documents in ids (doc_id), stored."""
    return common.checkpointed(_sets(docs, ids.select("doc_id").distinct(), width))


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with the shingle sets x of a and y of b and the size of their intersection."""
    full = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    return full.withColumn("both", F.size(F.array_intersect("x", "y")))


def _linked(percent: int):
    return F.lit(100) * F.col("both") >= F.lit(percent) * (F.size("x") + F.size("y") - F.col("both"))


def _compared(docs: DataFrame, pairs: DataFrame, sketch: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b, star) that sizes and sketches don't rule out, or stars, with ``linked`` from the full sets."""
    lanes = range(BITS // 64)
    pairs = pairs.join(sketch.select(F.col("rep").alias("a"), F.col("n").alias("na"), *(F.col(f"s{i}").alias(f"a{i}") for i in lanes)), "a")
    pairs = pairs.join(sketch.select(F.col("rep").alias("b"), F.col("n").alias("nb"), *(F.col(f"s{i}").alias(f"b{i}") for i in lanes)), "b")
    apart = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in lanes), F.lit(0))
    close = (F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")) & (apart <= FAR)
    todo = common.checkpointed(pairs.select("a", "b", "star", close.alias("close")).where("close or star"))
    near = todo.where("close").select("a", "b", "star")
    done = _with_sets(near, _stored_sets(docs, near.select(F.explode(F.array("a", "b")).alias("doc_id")), width)).select("a", "b", "star", _linked(percent).alias("linked"))
    out = common.checkpointed(done.unionByName(todo.where("not close").select("a", "b", "star", F.lit(False).alias("linked"))))
    common.release(docs)
    return out


def _centres(inside: DataFrame, sets: DataFrame) -> DataFrame:
    """(group, a, main): the member of each group that is closest to the group's consensus, and its component.

    The consensus holds the shingles of most of about SAMPLE members, told by a hash.
    Any member would do as a centre; near the consensus the differences are small.
    """
    some = inside.join(inside.groupBy("group").agg(F.count("*").alias("size")), "group").where(F.pmod(F.xxhash64("b"), F.col("size")) < SAMPLE)
    some = common.checkpointed(some.select("group", F.col("b").alias("doc_id")).join(sets, "doc_id").select("group", "shingles"))
    often = some.select("group", F.explode("shingles").alias("e")).groupBy("group", "e").agg(F.count("*").alias("k"))
    often = often.join(some.groupBy("group").agg(F.count("*").alias("size")), "group").where("2 * k > size").groupBy("group").agg(F.collect_list("e").alias("often"))
    known = inside.join(sets.select(F.col("doc_id").alias("b"), "shingles"), "b").join(often, "group", "left")
    both = F.coalesce(F.size(F.array_intersect("shingles", "often")), F.lit(0))
    like = known.select("group", "b", "component", (both / (F.size("shingles") + F.coalesce(F.size("often"), F.lit(0)) - both)).alias("like"))
    best = like.groupBy("group").agg(F.max_by(F.struct("b", "component"), F.struct("like", -F.col("b"))).alias("best"))
    return common.checkpointed(best.select("group", F.col("best.b").alias("a"), F.col("best.component").alias("main")))


def _frequent(full: DataFrame) -> DataFrame:
    """(a, often): shingles that several of about SAMPLE differences of a centre's group hold, rarest first; they only order what is dealt."""
    some = full.join(full.groupBy("a").agg(F.count("*").alias("size")), "a").where(F.pmod(F.xxhash64("rep"), F.col("size")) < SAMPLE)
    held = some.select("a", F.explode("differ").alias("e")).groupBy("a", "e").agg(F.count("*").alias("k")).where("k > 1")
    return held.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("k", "e")))["e"].alias("often"))


def _rest(docs: DataFrame, stars: DataFrame, found: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of members of large buckets to their centre, and pairs (a, b, star) that may be linked and are in no common component yet."""
    label = common.checkpointed(components(found).select(F.col("node").alias("b"), "component"))
    group = common.checkpointed(components(stars.select("a", "b")))
    member = group.select(F.col("component").alias("group"), F.col("node").alias("b")).join(label, "b", "left").withColumn("component", F.coalesce("component", "b"))
    mixed = member.groupBy("group").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("group")
    inside = common.checkpointed(member.join(mixed, "group"))
    sets = _stored_sets(docs, inside.select(F.col("b").alias("doc_id")), width)
    pairs = inside.join(_centres(inside, sets), "group").where("a <> b").select("a", "b", "component", "main")
    full = _with_sets(pairs, sets).withColumn("linked", _linked(percent))
    # the links to the centre are given out, so what is linked to it is in its component
    own = F.when(F.col("linked"), F.col("main")).otherwise(F.col("component"))
    full = full.select("a", F.col("b").alias("rep"), F.col("component").alias("was"), own.alias("component"), "main", "linked", F.size("y").alias("n"), F.size("x").alias("nc"), F.concat(F.array_except("y", "x"), F.array_except("x", "y")).alias("differ"))
    full = common.checkpointed(full.withColumn("d", F.size("differ")))
    common.release(docs)
    central = full.where("linked and was <> main").select("a", F.col("rep").alias("b"))
    # what a link takes: of any, all but n (1 - t) / t; where the partner is not linked to the centre, whose size is nc, more than (d + (nc - n) (1 - t) / (1 + t)) / 2
    most = F.greatest(F.lit(1), F.expr(f"d - n * {100 - percent} div {percent}"))
    half = F.greatest(most, F.expr(f"(d * {100 + percent} + (nc - n) * {100 - percent}) div {2 * (100 + percent)} + 1"))
    full = full.withColumn("half", half).withColumn("need", F.when(F.col("linked"), half).otherwise(most))
    # two that share so many shingles share one of the first d - need + 1 of each, whatever order all are in: what is frequent comes last
    ordered = full.join(_frequent(full), "a", "left").withColumn("often", F.coalesce("often", F.array().cast("array<long>")))
    order = F.concat(F.array_sort(F.array_except("differ", "often")), F.array_intersect("often", "differ"))
    own = ["a", "rep", "component", "main", "linked", "n", "d", "half", "need"]
    front = ordered.select(*own, F.slice(order, F.lit(1), F.greatest(F.lit(0), F.expr("d - need + 1")).cast("int")).alias("front"))
    dealt = front.select(*own, F.posexplode("front").alias("at", "e"))
    dealt = common.checkpointed(dealt.select(F.xxhash64("a", "e").alias("key"), *own, F.expr("at <= d - half").alias("head"), F.expr("d - at - 1").alias("rest")))
    # two members that are both linked to the centre are not compared: these links hold them together
    shared = dealt.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("linked").alias("all"))
    dealt = dealt.join(shared.where("low <> high and not all").select("key"), "key")
    # of a row's keys left: how many come before, how many there are, in the whole front and in its head
    row = Window.partitionBy("a", "rep")
    dealt = dealt.withColumn("at", F.row_number().over(row.orderBy(F.desc("rest"), "key")) - 1).withColumn("s", F.count("*").over(row)).withColumn("sh", F.count_if("head").over(row))
    dealt = common.checkpointed(dealt)
    x, y = dealt.where("component <> main").alias("x"), dealt.alias("y")
    # twice what two members must share, times 100 + percent
    must = f"((x.d + y.d) * {100 + percent} - (x.n + y.n) * {100 - percent})"
    near = f"x.component <> y.component and (y.linked or x.head and y.head) and (y.component = y.main or x.rep < y.rep) and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    near += f" and abs(x.d - y.d) * {100 + percent} <= (x.n + y.n) * {100 - percent} and {must} <= 2 * {100 + percent} * least(x.d, y.d)"
    # all keys are in one order.  What two share up to the end of the front that ends first is seen, and less than that one's need lies behind it
    hidden = "greatest(if(y.linked, x.need, x.half), y.half) - 1"
    behind = f"least(x.rest, y.rest, least(if(y.linked, x.s, x.sh) - x.at, y.sh - y.at) - 1 + {hidden})"
    near += f" and {must} <= 2 * {100 + percent} * (least(x.at, y.at) + 1 + {behind})"
    met = x.join(y, "key").where(near).groupBy(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
    met = met.agg(F.count("*").alias("shared"), F.min(F.expr(f"least(x.rest, y.rest, {hidden})")).alias("more"), F.max(F.expr(must)).alias("must"))
    return central, met.where(F.col("must") <= 2 * (100 + percent) * (F.col("shared") + F.col("more"))).select("a", "b", F.lit(False).alias("star"))


def links(docs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (a, b) between representatives (rep, n, bands, s0..) that give the components of all pairs at percent / 100."""
    sketch = reps.select("rep", "n", *(f"s{i}" for i in range(BITS // 64)))
    members = reps.select("rep", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("key"), "rep")
    first = _compared(docs, _bucket_pairs(members), sketch, width, percent)
    found, stars = first.where("linked").select("a", "b"), first.where("star")
    if stars.isEmpty():
        return found
    central, near = _rest(docs, stars, found, width, percent)
    second = _compared(docs, near, sketch, width, percent)
    return found.unionByName(central).unionByName(second.where("linked").select("a", "b"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for docs (doc_id, text)."""
    sig = common.checkpointed(signatures(docs, width))
    lanes = [f"s{i}" for i in range(BITS // 64)]
    classes = sig.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), *(F.first(c).alias(c) for c in lanes))
    classes = common.checkpointed(classes)
    common.release(docs)
    found = links(docs, classes.where("rep is not null").select("rep", "n", "bands", *lanes), width, percent)
    # rows of one id in several classes connect those
    held = sig.where("n > 0 and doc_id is not null").select("doc_id", "f1", "f2", "n").join(classes.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"]).select("doc_id", "rep")
    several = common.checkpointed(held.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("doc_id", "a"))
    if not several.isEmpty():
        found = found.unionByName(held.join(several, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b")).distinct())
    label = common.checkpointed(components(found))
    common.release(docs)
    of = classes.select("f1", "f2", "n", "rep").join(label, F.col("rep") == F.col("node"), "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("component_id"))
    out = sig.select("doc_id", "n", "f1", "f2").join(of, ["f1", "f2", "n"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op7_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"), width=2, percent=80)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM d
), u AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS k FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM u a JOIN u b ON a.k = b.k AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id
), e AS (
  SELECT x, y FROM p WHERE 100 * n_both >= 80 * (na + nb - n_both) UNION ALL SELECT y, x FROM p WHERE 100 * n_both >= 80 * (na + nb - n_both)
), r AS (
  SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
), m AS (
  SELECT x, min(y) AS y FROM r GROUP BY x
)
SELECT s.doc_id AS doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.y, s.doc_id)) AS component_id, coalesce(m.y, s.doc_id) >= s.doc_id AS kept
FROM s LEFT JOIN m ON s.doc_id = m.x
"""
