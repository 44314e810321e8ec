import pytest
from pyspark.sql import functions as F

from ledgerline.operators import repairs


@pytest.mark.parametrize(
    "quote,value,year",
    [("flow was 5. 59 in 1968 compared with 4.8 in 1967", 5.59, 1968), ("flow was 5.59 in 1968 compared with 4.8 in 1967", 4.8, 1967), ("flow was 5.59 in 1968", 5.59, None), ("1968 against 1967: 12 and 12", 12.0, None), (None, 1.0, None), ("1968 versus 1967", None, None)],
)
def test_nearest_year(quote, value, year):
    assert repairs.nearest_year(quote, value) == year


def test_corrections(spark):
    x = spark.createDataFrame([("flow 5.5 in 1968 compared with 4.8 in 1967", 4.8, "1968"), ("flow 5.5 in 1968 compared with 4.8 in 1967", 5.5, "1968"), ("flow", 1.0, "1968")], "quote string, value double, period string")
    assert [(r.outcome, r.period) for r in repairs.corrected_years(x).collect()] == [("change", "1967"), ("agree", "1968"), ("abstain", "1968")]
    items = spark.createDataFrame([("i", 1961, "Elora sewage works report")], "identifier string, year int, title string")
    rec = spark.createDataFrame([("i", "March", None), ("i", "1960", "x"), ("j", "May", " ")], "identifier string, period string, facility string")
    assert {r.period for r in repairs.anchored_periods(rec, items).collect()} == {"1961 March", "1960", "May"}
    assert {r.facility for r in repairs.backfilled_facility(rec, items).collect()} == {"water pollution control plant", "x", None}


def test_quantities(spark):
    x = spark.createDataFrame([(6.12, "million gallons", "Daily flow"), (2.0, "MGD", "flow"), (1.0, "cu. ft.", "grit"), (None, "mg / l", "x")], "v double, u string, p string")
    assert [tuple(r.q) for r in x.select(repairs.canonical_quantity("v", "u", "p").alias("q")).collect()] == [(6.12e6, "gallons/day"), (2e6, "gallons/day"), (1.0, "cu ft"), (None, "mg/l")]


def test_values_and_towns(spark):
    rec = spark.createDataFrame([(1, 69689.0), (1, 5.5), (1, None)], "page int, value double")
    pages = spark.createDataFrame([(1, "69 68g, 9 69 689")], "page int, text string")
    assert tuple(repairs.values_in_text(rec, pages, ["page"]).first()) == (1, 2, 1)
    t = spark.createDataFrame([("Elora",), ("Elora Sewage Treatment Plant",), ("Galt",), (None,)], "p string")


@pytest.mark.parametrize("v,text", [(26200.0, "26,200"), (14760000.0, "14,760,000"), (8e9, "8e+09"), (0.00001, "1e-05"), (3.14159, "3.142"), (0.0, "0"), (None, ""), (-1234.5, "-1,234")])
def test_human_number(v, text):
    assert repairs.human_number(v) == text


def test_gates(spark):
    g = spark.createDataFrame([("A", "x", 45.0, -80.0), ("A", "y", 45.0, -80.0), ("b!", "", 95.0, -80.0)], "id string, name string, lat double, lon double")
    assert {r.problem: r.n for r in repairs.gazetteer_problems(g, (41, 57, -96, -74), 2, 10).collect()} == {"duplicate id": 2, "bad id": 1, "out of bounds": 1, "no name": 1, "shrunk below four fifths": 3}
    a = spark.createDataFrame([(["A"], "A", 1.0, None, "s"), (["a"], "B", 1.0, 2.0, "")], "names array<string>, canonical string, lat double, lon double, source string")
    assert {r.problem for r in repairs.alias_problems(a).collect()} == {"only one coordinate", "coordinate without source", "duplicate name"}
    items = spark.createDataFrame([("i", "Report 1968", None, "French", None), ("j", "x", None, "eng", 1960)], "identifier string, title string, date string, language string, year int")
    assert {(r.identifier, r.field, r.value) for r in repairs.metadata_proposals(items).collect()} == {("i", "language", "fre"), ("i", "year", "1968")}
    assert repairs.not_done(g, g.where(F.col("id") == "A"), ["id"]).count() == 1
