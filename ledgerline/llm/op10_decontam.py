"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are lower-cased runs of letters and digits.  A seed hashes the words at the
chosen positions of a fixed mask and ignores the others, so a substituted word
under an ignored position does not hide an overlap.  Seeds of documents and of
benchmark items are joined; around each hit the two texts are compared word by
word on the hit's diagonal.  A document overlaps an item if some WINDOW
consecutive words of that diagonal agree in all but SLACK places.  The two masks
together hit every such window, wherever its substitutions fall, so the seeds
lose nothing.  Items too short for a mask have a seed of all their words.

The benchmark is broadcast up to a checked number of words, and documents stream
past it.  Beyond, seeds are joined by shuffle, and only documents that are hit are
joined with their words again.

Defined cases: null and empty texts overlap nothing; items of fewer words than a
window must occur whole and unchanged, even one of a single word; items
without an id are left out of the pairs, not of the cleaning; a repeated item or document row gives the same single row; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Positions that a seed reads.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 7, 8))
WINDOW, SLACK = 13, 2
#: Words below which an item has no mask of its own in it.
SHORT = min(m[-1] for m in MASKS) + 1
#: Benchmark words up to which its seeds are broadcast.
BROADCAST_WORDS = 2_000_000


def _words(text):
    """Hashes of a text's words; null texts have none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, keep: list[str], pos: str, lengths: tuple[int, ...] = ()) -> DataFrame:
    """Columns ``keep``, then (pos, seed) for each position and mask that fits; lengths: also of so many words in a row."""
    masks = [(f"m{k}", m) for k, m in enumerate(MASKS)] + [(f"w{n}", tuple(range(n))) for n in lengths]
    least = min(m[-1] for _, m in masks) + 1
    at = F.when(F.size("h") >= least, F.sequence(F.lit(0), F.size("h") - least))
    rows = rows.select(*keep, "h", F.explode(at).alias(pos))
    keys = [F.when(F.col(pos) + m[-1] < F.size("h"), F.xxhash64(F.lit(name), *(F.get("h", F.col(pos) + o) for o in m))) for name, m in masks]
    rows = rows.select(*keep, "h", pos, *(k.alias(f"k{i}") for i, k in enumerate(keys)))
    return rows.select(*keep, "h", pos, F.expr(f"stack({len(masks)}, {', '.join(f'k{i}' for i in range(len(masks)))}) as seed")).where("seed is not null")


def _verified(hits: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_equal, n_words) of the hits (doc_id, h, item_id, ih, start) whose diagonals agree."""
    start = F.col("start")
    same = F.transform(F.sequence(F.lit(0), F.size("ih") - 1), lambda j: F.when((start + j >= 0) & (F.get("h", F.greatest(start + j, F.lit(0))) == F.get("ih", j)), 1).otherwise(0))
    hits = hits.select("doc_id", "item_id", F.size("ih").alias("n_words"), same.alias("same"))
    hits = hits.withColumn("n_equal", F.aggregate("same", F.lit(0), lambda a, x: a + x))
    width = F.least(F.col("n_words"), F.lit(WINDOW))
    need = F.when(F.col("n_words") >= WINDOW, WINDOW - SLACK).otherwise(F.col("n_words"))
    window = F.exists(F.sequence(F.lit(1), F.col("n_words") - width + 1), lambda s: F.aggregate(F.slice("same", s, width), F.lit(0), lambda a, x: a + x) >= need)
    found = hits.where(F.col("n_equal") >= need).where(window)
    return found.groupBy("doc_id", "item_id").agg(F.max("n_equal").cast("long").alias("n_equal"), F.max("n_words").cast("long").alias("n_words"))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_equal, n_words) for docs (doc_id, text) and benchmark (item_id, text).

    n_equal is the largest number of agreeing words on one diagonal, n_words the item's length.
    """
    items = benchmark.select("item_id", _words(F.col("text")).alias("ih")).where("item_id is not null").distinct()
    short = F.array_sort(F.collect_set(F.when((F.size("ih") > 0) & (F.size("ih") < SHORT), F.size("ih"))))
    known = items.agg(F.sum(F.size("ih")).alias("words"), short.alias("short")).first()
    lengths = tuple(known["short"])
    seeds = _seeds(items.select("item_id", F.col("ih").alias("h")), ["item_id"], "at", lengths)
    # an item below SHORT words is told by all of them, not by what others share with it
    seeds = seeds.join(items.select("item_id", F.size("ih").alias("n")).distinct(), "item_id") if lengths else seeds
    seeds = seeds.select("seed", "item_id", "at", F.col("h").alias("ih"))
    own = F.when(F.size("ih") < SHORT, F.size("ih")).otherwise(0)
    told = F.lit(False)
    for n in lengths:
        told = told | ((own == n) & (F.col("at") == 0) & (F.col("seed") == F.xxhash64(F.lit(f"w{n}"), *(F.get("ih", F.lit(i)) for i in range(n)))))
    seeds = seeds.where((own == 0) | told) if lengths else seeds
    texts = docs.select("doc_id", "text", common.row_key().alias("_row"))
    if (known["words"] or 0) <= BROADCAST_WORDS:
        hits = _seeds(texts.select("doc_id", _words(F.col("text")).alias("h")), ["doc_id"], "pos", lengths)
        hits = hits.join(F.broadcast(seeds.select("seed", "item_id", "at")), "seed").join(F.broadcast(items), "item_id")
        return _verified(hits.select("doc_id", "h", "item_id", "ih", (F.col("pos") - F.col("at")).alias("start")))
    # neither words nor texts ride on a seed: only (row, place, seed) is shuffled, and each diagonal is verified once
    hashed = texts.select("_row", "doc_id", _words(F.col("text")).alias("h")).dropDuplicates(["_row"])
    hits = _seeds(hashed, ["_row"], "pos", lengths).select("_row", "pos", "seed").join(seeds.select("seed", "item_id", "at"), "seed")
    hits = hits.select("_row", "item_id", (F.col("pos") - F.col("at")).alias("start")).distinct()
    return _verified(hits.join(hashed, "_row").join(items, "item_id"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that overlap no item, with all their columns; rows and items count whether they have an id or not."""
    items = benchmark.select(common.row_key("item_id").alias("item_id"), "text")
    found = overlaps(docs.select(common.row_key().alias("doc_id"), "text"), items)
    found = common.checkpointed(found.select(F.col("doc_id").alias("_key")).distinct())
    return common.without(docs.withColumn("_key", common.row_key()), found, key="_key").drop("_key")


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return overlaps(docs, common.table(spark, sf_dir, "benchmark").select("item_id", "text"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark
), dp AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 5)) AS p FROM d
), bp AS (
  SELECT item_id, w, unnest(range(1, len(w) - 5)) AS p FROM b
), ds AS (
  SELECT doc_id, p, concat_ws(' ', 'a', w[p], w[p+1], w[p+2], w[p+3], w[p+5], w[p+6]) AS k FROM dp
  UNION ALL SELECT doc_id, p, concat_ws(' ', 'b', w[p], w[p+1], w[p+2], w[p+4], w[p+7], w[p+8]) FROM dp WHERE p + 8 <= len(w)
), bs AS (
  SELECT item_id, p, concat_ws(' ', 'a', w[p], w[p+1], w[p+2], w[p+3], w[p+5], w[p+6]) AS k FROM bp
  UNION ALL SELECT item_id, p, concat_ws(' ', 'b', w[p], w[p+1], w[p+2], w[p+4], w[p+7], w[p+8]) FROM bp WHERE p + 8 <= len(w)
), diag AS (
  SELECT DISTINCT doc_id, item_id, ds.p - bs.p AS s FROM ds JOIN bs USING (k)
  UNION SELECT doc_id, item_id, p - 1 FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) x JOIN b ON len(b.w) BETWEEN 1 AND 6 AND x.w[p:p + len(b.w) - 1] = b.w
), same AS (
  SELECT doc_id, item_id, len(b.w) AS n,
         list_transform(range(1, len(b.w) + 1), lambda j: CASE WHEN s + j >= 1 AND s + j <= len(d.w) AND d.w[s + j] = b.w[j] THEN 1 ELSE 0 END) AS e
  FROM diag JOIN d USING (doc_id) JOIN b USING (item_id)
), ok AS (
  SELECT doc_id, item_id, n, list_sum(e) AS n_equal FROM same
  WHERE len(list_filter(range(1, n - least(n, 13) + 2), lambda i: list_sum(e[i:i + least(n, 13) - 1]) >= CASE WHEN n >= 13 THEN 11 ELSE n END)) > 0
)
SELECT doc_id, item_id, CAST(max(n_equal) AS BIGINT) AS n_equal, CAST(max(n) AS BIGINT) AS n_words FROM ok GROUP BY doc_id, item_id
"""
