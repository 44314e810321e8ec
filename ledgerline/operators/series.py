"""Series of readings: selection, normalisation, robust statistics, gaps, limits.

Points are rows of (keys..., t, v, c): time, value, confidence.  Every operator
groups by ``keys``; nothing is collected, and refusals are rows or columns.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.units import parse_unit

Keys = list[str]


def best_reading(readings: DataFrame, keys: Keys, t: str, v: str, c: str, *ties: str) -> DataFrame:
    """One reading for each key and time: most confident, then smallest value, then ``ties``.

    A minimum of structs, so partial aggregation leaves one row a task and key to shuffle.
    """
    order = F.struct((-F.col(c)).alias("a"), F.col(v).alias("b"), *(F.col(x) for x in ties))
    return readings.where(F.col(v).isNotNull()).groupBy(*keys, F.col(t).alias("t")).agg(F.min(order).alias("m")).select(*keys, "t", F.col("m.b").alias("v"), (-F.col("m.a")).alias("c"))


def _pairs(points: DataFrame, keys: Keys) -> DataFrame:
    a = points.select(*keys, F.col("t").alias("t1"), F.col("v").alias("v1"))
    b = points.select(*keys, F.col("t").alias("t2"), F.col("v").alias("v2"))
    return a.join(b, keys).where("t1 < t2")


def theil_sen(points: DataFrame, keys: Keys) -> DataFrame:
    """keys, n, slope: median of the slopes of all pairs at different times, 0 without a pair."""
    slopes = _pairs(points, keys).groupBy(*keys).agg(F.median((F.col("v2") - F.col("v1")) / (F.col("t2") - F.col("t1"))).alias("s"))
    n = points.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.join(slopes, keys, "left").select(*keys, "n", F.coalesce("s", F.lit(0.0)).alias("slope"))


def mann_kendall(points: DataFrame, keys: Keys) -> DataFrame:
    """keys, n, s, var_s, z: the rank trend statistic with its variance corrected for ties."""
    s = _pairs(points, keys).groupBy(*keys).agg(F.sum(F.signum(F.col("v2") - F.col("v1"))).cast("long").alias("s"))
    ties = points.groupBy(*keys, "v").agg(F.count("*").alias("_tied")).groupBy(*keys).agg(F.sum("_tied").alias("n"), F.sum(F.when(F.col("_tied") > 1, F.expr("_tied * (_tied - 1) * (2 * _tied + 5)")).otherwise(0)).alias("tie"))
    out = ties.join(s, keys, "left").withColumn("s", F.coalesce("s", F.lit(0)))
    var = (F.expr("n * (n - 1) * (2 * n + 5)") - F.col("tie")).cast("double") / F.lit(18.0)
    out = out.withColumn("var_s", var)
    z = F.when(F.col("var_s") <= 0, F.lit(0.0)).otherwise((F.col("s") - F.signum(F.col("s").cast("double"))) / F.sqrt("var_s"))
    return out.select(*keys, "n", "s", "var_s", z.alias("z"))


def pettitt(points: DataFrame, keys: Keys, min_n: int = 8) -> DataFrame:
    """keys, n, at, k, p_value, mean_before, mean_after, shift, detected, reason: the likeliest shift of the median."""
    own, by_value = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("v")
    x = points.withColumn("n", F.count("*").over(own)).withColumn("ties", F.count("*").over(Window.partitionBy(*keys, "v")))
    x = x.withColumn("r", F.rank().over(by_value) + (F.col("ties") - 1) / F.lit(2.0)).withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("t", "v")))
    upto = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("u", F.lit(2.0) * F.sum("r").over(upto) - F.col("i") * (F.col("n") + 1)).withColumn("next", F.lead("t").over(Window.partitionBy(*keys).orderBy("i")))
    best = F.max(F.when(F.col("i") < F.col("n"), F.struct(F.abs("u").alias("k"), (-F.col("i")).alias("i"), F.col("next").alias("at"))))
    top = x.groupBy(*keys).agg(best.alias("b"), F.max("n").alias("n"))
    x = x.join(top.select(*keys, (-F.col("b.i")).alias("cut")), keys, "left")
    means = x.groupBy(*keys).agg(F.avg(F.when(F.col("i") <= F.col("cut"), F.col("v"))).alias("mean_before"), F.avg(F.when(F.col("i") > F.col("cut"), F.col("v"))).alias("mean_after"))
    n3 = F.pow(F.col("n").cast("double"), F.lit(3.0)) + F.pow(F.col("n").cast("double"), F.lit(2.0))
    p = F.least(F.lit(1.0), F.lit(2.0) * F.exp(F.lit(-6.0) * F.col("b.k") * F.col("b.k") / n3))
    few = F.col("n") < min_n
    out = top.join(means, keys).select(*keys, "n", F.when(~few, F.col("b.at")).alias("at"), F.when(~few, F.col("b.k")).alias("k"), F.when(~few, p).alias("p_value"), F.when(~few, F.col("mean_before")).alias("mean_before"), F.when(~few, F.col("mean_after")).alias("mean_after"))
    return out.withColumn("shift", F.col("mean_after") - F.col("mean_before")).withColumn("detected", F.coalesce(F.col("p_value") < 0.05, F.lit(False))).withColumn("reason", F.when(few, F.concat(F.lit("only "), F.col("n").cast("string"), F.lit(f" readings; need {min_n}"))))


# Draws of a trend, years it takes, seed of the published figures, draws that must succeed, share of the tails.
DRAWS, YEARS, SEED, ENOUGH, TAIL = 500, 6, 12345, 20, 0.05


def _median_slope(t: np.ndarray, v: np.ndarray) -> float:
    """Median of the slopes between all points at different times; 0 without any."""
    i, j = np.triu_indices(len(t), 1)
    dt = t[j] - t[i]
    slopes = (v[j] - v[i])[dt != 0] / dt[dt != 0]
    return float(np.median(slopes)) if len(slopes) else 0.0


def _draws(n: int, c: np.ndarray, replicates: int, seed: int):
    """Index sets of the replicates: n drawn with replacement, each kept with the probability of its confidence, in time order."""
    rng = random.Random(seed)
    for _ in range(replicates):
        picked = np.array([rng.randrange(n) for _ in range(n)])
        kept = np.array([rng.random() for _ in range(n)]) <= c[picked]
        yield np.sort(picked[kept], kind="stable")


def _rank_trend(v: np.ndarray) -> tuple[int, float]:
    """S of the rank trend and its two-sided p, variance corrected for ties, with continuity."""
    n = len(v)
    i, j = np.triu_indices(n, 1)
    s = int(np.sign(v[j] - v[i]).sum())
    ties = np.unique(v, return_counts=True)[1]
    var = (n * (n - 1) * (2 * n + 5) - float((ties * (ties - 1) * (2 * ties + 5)).sum())) / 18.0
    return s, min(1.0, math.erfc(abs(s - np.sign(s)) / math.sqrt(2.0 * var))) if var > 0 else 1.0


def trend(points: DataFrame, keys: Keys, replicates: int = DRAWS, min_n: int = YEARS, seed: int = SEED) -> DataFrame:
    """Trend of each series with an interval that widens as the readings lose confidence.

    One grouped call a series: the draws of a generator follow each other, and a series
    is a few readings a year.  What cannot be told is a row with its reason.
    """
    types = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    told = "ok boolean, reason string, n int, direction string, significant boolean, p_value double, slope double, low double, high double, stability double, mean_confidence double"
    names = [*keys, *(x.split()[0] for x in told.split(", "))]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t", kind="stable")
        t, v, c = (rows[k].to_numpy(float) for k in ("t", "v", "c"))
        c, n = np.clip(c, 0.0, 1.0), len(t)
        out = dict.fromkeys(names) | {k: rows[k].iloc[0] for k in keys} | {"n": n, "mean_confidence": float(c.mean()), "ok": False}
        if n < min_n:
            return pd.DataFrame([out | {"reason": f"only {n} readings; need {min_n}"}])
        some = (d for d in _draws(n, c, replicates, seed) if len(d) >= 3 and t[d[0]] != t[d[-1]])
        slopes = np.sort([_median_slope(t[d], v[d]) for d in some])
        if len(slopes) < ENOUGH:
            return pd.DataFrame([out | {"reason": "reading confidence too low to bootstrap a stable slope"}])
        s, p = _rank_trend(v)
        slope, last = _median_slope(t, v), len(slopes) - 1
        ends = {"low": slopes[int(TAIL * last)], "high": slopes[int((1 - TAIL) * last)]}
        way = ("flat", "increasing", "decreasing")[int(np.sign(s))]
        return pd.DataFrame([out | ends | {"ok": True, "reason": "", "direction": way, "significant": p < 0.05, "p_value": p, "slope": slope, "stability": float((np.sign(slopes) == np.sign(slope)).mean())}])

    return points.groupBy(*keys).applyInPandas(one, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + told)


def suspects(points: DataFrame, keys: Keys) -> DataFrame:
    """Points that look like scan damage: keys, t, v, median, power (of ten that would explain it, or null), far."""
    med = points.groupBy(*keys).agg(F.median("v").alias("median"), F.count("*").alias("n")).where("n >= 3 and median <> 0")
    x = points.join(med, keys)
    mad = x.groupBy(*keys).agg(F.median(F.abs(F.col("v") - F.col("median"))).alias("mad"))
    x = x.join(mad, keys).withColumn("far", (F.col("mad") > 0) & (F.abs(F.col("v") - F.col("median")) > F.lit(4.45) * F.col("mad")))
    x = x.where((F.col("v") != 0) & (F.col("far") | (F.abs(F.col("v") - F.col("median")) > F.abs("median"))))
    power = F.coalesce(*(F.when(F.abs(F.col("v") * F.lit(10.0**p) - F.col("median")) <= F.lit(0.5) * F.abs("median"), F.lit(p)) for p in (-3, -2, -1, 1, 2, 3)))
    return x.withColumn("power", power).where("power is not null or far").select(*keys, "t", "v", "median", "power", "far")


def majority_unit(readings: DataFrame, keys: Keys, unit: str = "unit", ord_: str = "ord", era: str | None = None, flow: str | None = None) -> DataFrame:
    """Each reading with ``parsed_unit``, ``series_unit`` (the base unit that most of its series has, ties: the first seen) and ``rejected``, its refusal, if any.

    Distinct units are parsed once and joined back.
    """
    given = [unit, *(x for x in (era, flow) if x)]
    hidden = [f"_given{i}" for i in range(len(given))]
    parsed = readings.select(*(F.col(g).alias(h) for g, h in zip(given, hidden, strict=True))).distinct()
    known = dict(zip(("unit", "era", "flow") if era and flow else ("unit", "era") if era else ("unit", "flow"), hidden, strict=False))
    parsed = parsed.withColumn("_q", parse_unit(known["unit"], known.get("era"), known.get("flow")))
    same = [F.col(g).eqNullSafe(F.col(h)) for g, h in zip(given, hidden, strict=True)]
    x = readings.join(parsed, same, "left").drop(*hidden).withColumn("_base", F.col("_q.base"))
    # one exchange by the series: votes are counted where its readings lie together
    series, by_unit = Window.partitionBy(*keys), Window.partitionBy(*keys, "_base")
    vote = F.when(F.col("_base").isNotNull(), F.struct((-F.count("*").over(by_unit)).alias("votes"), F.min(ord_).over(by_unit).alias("first"), F.col("_base").alias("unit")))
    x = x.withColumn("_vote", vote).withColumn("series_unit", F.min("_vote").over(series)["unit"]).drop("_vote")
    why = F.when(F.col("_base").isNull(), F.concat(F.lit("unrecognised unit "), F.coalesce(F.col(unit), F.lit("none")))).when(F.col("_base") != F.col("series_unit"), F.concat(F.col("_base"), F.lit(" ("), F.col("_q.dimension"), F.lit(") is not comparable with the series unit "), F.col("series_unit")))
    return x.withColumn("rejected", why).drop("_base").withColumnRenamed("_q", "parsed_unit")


def silence(years: DataFrame, keys: Keys, year: str = "year", horizon: int | None = None) -> DataFrame:
    """keys, first_year, last_year, reported, missing, longest_gap, continuity, silent_since of distinct reporting years."""
    x = years.where(F.col(year).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_set(F.col(year).cast("int"))).alias("reported"))
    x = x.withColumn("first_year", F.element_at("reported", 1)).withColumn("last_year", F.element_at("reported", -1))
    x = x.withColumn("missing", F.array_except(F.sequence("first_year", "last_year"), "reported"))
    gaps = F.transform(F.col("reported"), lambda y, i: F.when(i > 0, y - F.get("reported", i - 1) - 1).otherwise(0))
    since = F.when(F.col("last_year") < F.lit(horizon), F.col("last_year") + 1) if horizon is not None else F.lit(None).cast("int")
    return x.select(*keys, "first_year", "last_year", "reported", "missing", F.array_max(gaps).alias("longest_gap"), (F.size("reported") / (F.col("last_year") - F.col("first_year") + 1)).alias("continuity"), since.alias("silent_since"))


def exceedance(observations: DataFrame, keys: Keys, value: str, limit: str, year: str) -> DataFrame:
    """keys, n, n_exceeding, rate, years: observations strictly above the limit of their own time."""
    over = F.col(value) > F.col(limit)
    return observations.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(over).alias("n_exceeding"), F.sort_array(F.collect_set(F.when(over, F.col(year)))).alias("years")).withColumn("rate", F.col("n_exceeding") / F.col("n"))


def standard_for(observations: DataFrame, standards: DataFrame, keys: Keys, obs_id: str, max_gap: int = 15) -> DataFrame:
    """Each observation (keys, obs_id, year) with the limits of its time: values of the nearest earlier year, else of the nearest later one.

    obs_id, standard_year, values, verdict: ``limit`` for one value, ``range`` for two, ``ambiguous`` for more.
    """
    s = standards.select(*keys, F.col("year").alias("sy"), F.col("value").alias("sv"))
    x = observations.join(s, keys).withColumn("gap", F.abs(F.col("year") - F.col("sy"))).where(F.col("gap") <= max_gap).withColumn("later", (F.col("sy") > F.col("year")).cast("int"))
    best = x.groupBy(obs_id).agg(F.min(F.struct("later", "gap")).alias("m"))
    x = x.join(best, obs_id).where("later = m.later and gap = m.gap")
    out = x.groupBy(obs_id).agg(F.min("sy").alias("standard_year"), F.sort_array(F.collect_set("sv")).alias("values"))
    n = F.size("values")
    return out.withColumn("verdict", F.when(n == 1, "limit").when(n == 2, "range").otherwise("ambiguous"))
