"""Coverage of a vocabulary, proportions, strata, allocation, harvesting, frontier ranking."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wilson(hits, n, z: float = 1.96) -> Column:
    """Struct of low and high for a proportion."""
    hits, n = (F.col(x).cast("double") if isinstance(x, str) else x.cast("double") for x in (hits, n))
    p, zz = hits / n, z * z
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(zz / 4) / (n * n)) / (F.lit(1.0) + F.lit(zz) / n)
    mid = (p + F.lit(zz / 2) / n) / (F.lit(1.0) + F.lit(zz) / n)
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), mid - half).alias("low"), F.least(F.lit(1.0), mid + half).alias("high")))


def coverage(terms: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Good-Turing coverage and Chao1 richness of term counts: keys, readings, observed, f1, f2, coverage, chao1, low, high."""
    x = terms.groupBy(*keys).agg(F.sum(count).alias("readings"), F.count("*").alias("observed"), F.count_if(F.col(count) == 1).alias("f1"), F.count_if(F.col(count) == 2).alias("f2"))
    f1, f2, obs = (F.col(c).cast("double") for c in ("f1", "f2", "observed"))
    extra = f1 * (f1 - 1) / (F.lit(2.0) * (f2 + 1))
    x = x.withColumn("coverage", F.when(F.col("readings") > 0, F.lit(1.0) - f1 / F.col("readings"))).withColumn("chao1", obs + extra)
    ratio = f1 / (f2 + 1)
    var = (f2 + 1) * (F.lit(0.5) * F.pow(ratio, F.lit(2.0)) + F.pow(ratio, F.lit(3.0)) + F.lit(0.25) * F.pow(ratio, F.lit(4.0)))
    k = F.exp(F.lit(1.96) * F.sqrt(F.log(F.lit(1.0) + var / (extra * extra))))
    return x.withColumn("low", F.when(extra > 0, obs + extra / k).otherwise(obs)).withColumn("high", F.when(extra > 0, obs + extra * k).otherwise(obs))


def rarest_stratum(items: DataFrame, item: str, collection: str, generic: list[str]) -> DataFrame:
    """(item, stratum): the rarest of an item's collections (rows of item, collection) that is not generic, else ``unsorted``."""
    size = items.groupBy(collection).agg(F.count("*").alias("size"))
    x = items.join(size, collection)
    ok = ~F.col(collection).isin(generic) if generic else F.lit(True)
    return x.groupBy(item).agg(F.min(F.when(ok, F.struct("size", collection))).alias("m")).select(item, F.coalesce(F.col(f"m.{collection}"), F.lit("unsorted")).alias("stratum"))


def first_stratum(collections, generic: list[str]) -> Column:
    """The first of an item's collections that is not generic, else ``unsorted``."""
    c = F.col(collections) if isinstance(collections, str) else collections
    return F.coalesce(F.get(F.filter(c, lambda x: ~x.isin(*generic) if generic else F.lit(True)), F.lit(0)), F.lit("unsorted"))


def waiting(questions: DataFrame) -> DataFrame:
    """Questions (needs, value) that something is missing for, the nearest and most valuable first."""
    return questions.withColumn("distance", F.size("needs")).where("distance > 0").orderBy("distance", F.desc("value"), "kind", "subject")


def unlocks(questions: DataFrame, place: str) -> DataFrame:
    """Questions for which this one place is all that is missing."""
    return questions.where((F.size("needs") == 1) & (F.lower(F.trim(F.get("needs", F.lit(0)))) == place.strip().lower()))


def allocate(sizes: dict[str, int], budget: int, floor: int = 1) -> dict[str, int]:
    """Square-root allocation of a budget to strata, at least ``floor`` each and no more than there is; strata are few by nature."""
    names = sorted(k for k, n in sizes.items() if n > 0)
    if not names or budget <= 0:
        return {}
    root = sum(math.sqrt(sizes[k]) for k in names)
    out = {k: min(sizes[k], max(floor, round(budget * math.sqrt(sizes[k]) / root))) for k in names}
    while sum(out.values()) > budget:
        big = max(names, key=lambda k: (out[k], k))
        if out[big] <= floor:
            break
        out[big] -= 1
    return out


def harvest(records: DataFrame, stem: str, variant: str, unit: str, example: str, min_count: int = 3, keep: int = 3) -> DataFrame:
    """Stems seen min_count times: (stem, n, variants, units, examples); lists most frequent first, ties by text."""
    n = records.groupBy(stem).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)

    def top(c: str, name: str) -> DataFrame:
        x = records.where(F.col(c).isNotNull()).groupBy(stem, c).agg(F.count("*").alias("k"))
        # cut before collecting: a stem may have any number of variants
        x = x.withColumn("at", F.row_number().over(Window.partitionBy(stem).orderBy(F.desc("k"), c))).where(F.col("at") <= keep)
        return x.groupBy(stem).agg(F.sort_array(F.collect_list(F.struct("at", F.col(c).alias("v")))).alias(name)).select(stem, F.col(f"{name}.v").alias(name))

    return n.join(top(variant, "variants"), stem, "left").join(top(unit, "units"), stem, "left").join(top(example, "examples"), stem, "left")


def ranked_places(questions: DataFrame) -> DataFrame:
    """(place, score): sum of value over squared distance of the questions (needs, have, value) that a place would bring nearer."""
    x = questions.withColumn("left", F.array_except("needs", "have")).withColumn("distance", F.size("left")).where("distance > 0")
    return x.select(F.explode("left").alias("place"), (F.col("value") / (F.col("distance") * F.col("distance"))).alias("w")).groupBy("place").agg(F.sum("w").alias("score"))


def sample_plan(pages: DataFrame, stratum: str, item: str, page: str, quota: dict[str, int], page_cap: int = 40, seed: int = 4242) -> DataFrame:
    """Pages of a stratified sample: at most page_cap an item, in an order that depends on the seed and ids alone."""
    order = F.xxhash64(F.lit(seed), item, page)
    x = pages.withColumn("k", F.row_number().over(Window.partitionBy(item).orderBy(order, page))).where(F.col("k") <= page_cap).drop("k")
    want = F.create_map(*(F.lit(v) for kv in quota.items() for v in kv)) if quota else F.create_map()
    x = x.withColumn("k", F.row_number().over(Window.partitionBy(stratum).orderBy(order, item, page)))
    return x.where(F.col("k") <= F.coalesce(F.try_element_at(want, F.col(stratum)), F.lit(0))).drop("k")
