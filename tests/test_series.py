import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import series


def points(spark, values, key="a"):
    return spark.createDataFrame([(key, float(t), float(v), 0.9) for t, v in enumerate(values)], "k string, t double, v double, c double")


def test_best_reading_prefers_confidence_then_the_smaller_value(spark):
    rows = [("a", 1, 5.0, 0.5), ("a", 1, 9.0, 0.8), ("a", 1, 7.0, 0.8), ("a", 2, None, 0.9), ("b", 1, 1.0, 0.1)]
    x = series.best_reading(spark.createDataFrame(rows, "k string, y int, v double, c double"), ["k"], "y", "v", "c")
    assert {(r.k, r.t, r.v, r.c) for r in x.collect()} == {("a", 1, 7.0, 0.8), ("b", 1, 1.0, 0.1)}


def test_theil_sen_is_the_median_slope(spark):
    x = points(spark, [0, 1, 2, 30, 4])
    assert series.theil_sen(x, ["k"]).first().slope == 1.0
    assert series.theil_sen(points(spark, [3]), ["k"]).first().slope == 0.0


def test_mann_kendall_corrects_ties(spark):
    r = series.mann_kendall(points(spark, [1, 1, 2, 3]), ["k"]).first()
    assert (r.n, r.s) == (4, 5)
    assert r.var_s == pytest.approx((4 * 3 * 13 - 2 * 1 * 9) / 18)
    assert r.z == pytest.approx(4 / math.sqrt(r.var_s))


def test_pettitt_finds_the_step_and_refuses_short_series(spark):
    r = series.pettitt(points(spark, [177] * 5 + [90] * 5), ["k"]).first()
    assert (r.at, r.shift, r.detected) == (5.0, -87.0, False)
    assert round(r.p_value, 3) == 0.066
    short = series.pettitt(points(spark, [1, 2, 3]), ["k"]).first()
    assert short.at is None and short.reason == "only 3 readings; need 8"


def test_trend_carries_confidence_and_refuses(spark):
    r = series.trend(points(spark, [1, 2, 3, 4, 5, 6, 7]), ["k"]).first()
    assert r.ok and r.direction == "increasing" and r.significant and r.slope == 1.0 and r.low <= 1.0 <= r.high
    few = series.trend(points(spark, [1, 2]), ["k"]).first()
    assert not few.ok and few.reason == "only 2 readings; need 6"
    weak = points(spark, range(8)).withColumn("c", F.lit(0.0))
    assert "confidence too low" in series.trend(weak, ["k"]).first().reason


def test_suspects_name_the_power_of_ten(spark):
    r = series.suspects(points(spark, [1400, 1450, 1500, 144.2, 1480]), ["k"]).collect()
    assert [(x.v, x.power) for x in r] == [(144.2, 1)]
    assert series.suspects(points(spark, [1, 2]), ["k"]).count() == 0


def test_majority_unit_keeps_refusals(spark):
    rows = [("a", 1, "mg/L"), ("a", 2, "ppm"), ("a", 3, "MGD"), ("a", 4, "furlongs"), ("a", 5, None)]
    x = series.majority_unit(spark.createDataFrame(rows, "k string, ord int, unit string"), ["k"]).orderBy("ord").collect()
    assert [r.rejected is None for r in x] == [True, True, False, False, False]
    assert "not comparable with the series unit mg/l" in x[2].rejected


def test_silence_counts_gaps_and_never_fills_them(spark):
    x = spark.createDataFrame([("a", y) for y in (1960, 1961, 1965, 1965)], "k string, year int")
    r = series.silence(x, ["k"], horizon=1970).first()
    assert (r.missing, r.longest_gap, r.silent_since) == ([1962, 1963, 1964], 3, 1966)
    assert series.silence(x, ["k"]).first().silent_since is None


def test_standard_of_the_time(spark):
    o = spark.createDataFrame([("p", 1, 1970), ("p", 2, 1955), ("p", 3, 1999)], "k string, id int, year int")
    s = spark.createDataFrame([("p", 1960, 5.0), ("p", 1968, 8.0), ("p", 1968, 9.0)], "k string, year int, value double")
    got = {r.id: (r.standard_year, r.verdict) for r in series.standard_for(o, s, ["k"], "id").collect()}
    assert got == {1: (1968, "range"), 2: (1960, "limit")}


def test_random_series_agree_with_plain_python(spark):
    rng = random.Random(1)
    for _ in range(3):
        v = [rng.randrange(6) for _ in range(12)]
        s = sum((b > a) - (b < a) for i, a in enumerate(v) for b in v[i + 1 :])
        assert series.mann_kendall(points(spark, v), ["k"]).first().s == s
