"""Accuracy of extracted readings against an answer key."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def values_match(a, b, rel: float = 0.01) -> Column:
    """Equal within a share of the larger magnitude."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce(F.abs(a - b) <= F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), a.isNull() & b.isNull())


def greedy_match(gold: DataFrame, got: DataFrame, keys: list[str], rel: float = 0.01, told: tuple[str, ...] = ()) -> DataFrame:
    """One-to-one matches in the order of the key: first with readings of the same kind, then with any: keys, gold_ord, got_ord, and gold_<c>, got_<c> for the columns told.

    The order is part of the meaning, so a page is matched as a whole.  Pages follow
    each other through a worker, which holds one at a time: a call for each would cost
    more than its matching.  Only readings whose values can agree are looked at: they
    lie together in value order.
    """
    types = {f.name: f.dataType.simpleString() for f in gold.schema.fields}
    theirs = {f.name: f.dataType.simpleString() for f in got.schema.fields}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "gold_ord long, got_ord long", *(f"`gold_{c}` {types[c]}, `got_{c}` {theirs[c]}" for c in told)])
    names = [*keys, "gold_ord", "got_ord", *(f"{side}_{c}" for c in told for side in ("gold", "got"))]
    width = len(keys)

    def matches(g: list, r: list) -> list:
        """(gold row, got row) of a page's rows (ord, value, unit, kind, ...), gold in the order of ord."""
        # candidates by unit (a missing unit agrees with a missing one), in the order of their values; missing values apart
        lists: dict = {}
        for i, (ord_, value, unit, kind, *_) in enumerate(r):
            none = value is None or value != value
            lists.setdefault((unit, none), []).append((0.0 if none else float(value), ord_, kind, i))
        for found in lists.values():
            found.sort(key=lambda x: x[:2])
        taken, matched, out = set(), set(), []
        for same_kind in (True, False):
            for row in g:
                ord_, value, unit, kind = row[:4]
                if ord_ in matched:
                    continue
                none = value is None or value != value
                found = lists.get((unit, none), [])
                v = 0.0 if none else float(value)
                reach = rel * abs(v) / (1 - rel) * (1 + 1e-9)
                near = found[bisect_left(found, (v - reach,)) : bisect_right(found, (v + reach, float("inf")))]
                fits = [(o, i) for w, o, k, i in near if o not in taken and abs(v - w) <= rel * max(abs(v), abs(w)) and (not same_kind or k == kind)]
                if fits:
                    o, i = min(fits)
                    matched.add(ord_)
                    taken.add(o)
                    out.append((row, r[i]))
        return out

    def run(batches):
        page, sides, found = None, ([], []), []

        def packed(batch):
            columns = [[f[0][k] for f in found] for k in range(width)] + [[f[side][0] for f in found] for side in (1, 2)]
            columns += [[f[side][-len(told) + k] for f in found] for k in range(len(told)) for side in (1, 2)]
            kinds = [*(batch.schema.field(k).type for k in range(width)), pa.int64(), pa.int64()]
            kinds += [batch.schema.field(len(batch.schema) - (2 - side) * len(told) + k).type for k in range(len(told)) for side in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        b = None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = row[:width]
                if page is None or not all(x == y or (x != x and y != y) for x, y in zip(own, page, strict=True)):
                    found += ((page, x, y) for x, y in matches(*sides))
                    page, sides = own, ([], [])
                side = row[width]
                at = len(row) - (2 - side) * len(told)
                sides[side].append((*row[width + 1 : width + 5], *row[at : at + len(told)]))
            if found:
                yield packed(b)
                found = []
        if b is not None:
            found += ((page, x, y) for x, y in matches(*sides))
            yield packed(b)

    def side(df: DataFrame, n: int) -> DataFrame:
        own = [F.col(k).cast(types[k]).alias(k) for k in keys]
        other = [(F.col(c) if n == m else F.lit(None).cast(t[c])).alias(f"_{m}_{c}") for m, t in enumerate((types, theirs)) for c in told]
        return df.select(*own, F.lit(n).alias("_side"), F.col("ord").cast("long").alias("_ord"), F.col("value").cast("double").alias("_value"), F.col("unit").cast("string").alias("_unit"), F.col("kind").cast("string").alias("_kind"), *other)

    rows = side(gold, 0).union(side(got, 1)).repartition(*keys).sortWithinPartitions(*keys, "_side", "_ord")
    return rows.mapInArrow(run, schema)


def totals(pages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 over pages (gold, got, matched) and the shares of matches with the right kind and stream (kind_ok, stream_ok, stream_n)."""
    s = lambda c: F.sum(c).cast("double")
    safe = lambda a, b: F.when(b > 0, a / b)
    x = pages.groupBy(*(keys or [])).agg(s("gold").alias("gold"), s("got").alias("got"), s("matched").alias("matched"), s("kind_ok").alias("kind_ok"), s("stream_ok").alias("stream_ok"), s("stream_n").alias("stream_n"))
    p, r = safe(F.col("matched"), F.col("got")), safe(F.col("matched"), F.col("gold"))
    return x.select(*(keys or []), p.alias("precision"), r.alias("recall"), safe(F.lit(2.0) * p * r, p + r).alias("f1"), safe(F.col("kind_ok"), F.col("matched")).alias("kind_accuracy"), safe(F.col("stream_ok"), F.col("stream_n")).alias("stream_accuracy"))
