import pytest

from ledgerline.operators import citations, records, vocabulary
from ledgerline.plans import views


def test_problems(spark):
    schema = "parameter string, kind string, value double, unit string, confidence double, provenance struct<source_text: string, path: string>"
    rows = [("flow", "observation", 1.0, "mg/l", 0.5, ("x", "prose")), (" ", "observation", None, None, 2.0, None), ("number of beds", "observation", 5.0, None, 0.5, ("x", "prose")), ("flow", "observation", float("nan"), None, 0.5, ("", "vision"))]
    got = [r.p for r in spark.createDataFrame(rows, schema).select(records.problems().alias("p")).collect()]
    assert got[0] == [] and got[2] == []
    assert got[1] == ["empty parameter", "no value", "no unit", "confidence out of range: 2.0", "no provenance"]
    assert got[3] == ["value is NaN", "no source text -- claim is not checkable"]


def test_json_problems(spark):
    rows = [('{"kind": "observation", "value": 1.5, "unit": "mg"}',), ('{"kind": "guess", "value": "1"}',), ("{",), ("[1]",)]
    got = [r.p for r in spark.createDataFrame(rows, "j string").select(records.json_problems("j").alias("p")).collect()]
    assert got[0] == [] and set(got[1]) == {"unknown kind", "value must be a number"} and "not JSON" in got[2] and "not an object" in got[3]


def test_months_and_titles(spark):
    x = records.fold_month(spark.createDataFrame([("March.", "1962"), ("Elora", "1962"), ("May", "1962-01")], "place string, period string")).collect()
    assert [(r.place, r.period) for r in x] == [(None, "1962-03"), ("Elora", "1962"), (None, "1962-01")]
    t = spark.createDataFrame([("Elora : water pollution control plant",), ("Annual report on the town of Paris water pollution control plant",), ("1963 operating summary water pollution control plant",)], "t string")
    assert [r.p for r in t.select(records.place_of_title("t").alias("p")).collect()] == ["Elora", "Paris", None]


@pytest.mark.parametrize("raw,n", [('[{"a": 1}, {"b": 2}]', 2), ('```json\n[{"a": 1}]\n```', 1), ('Here: [{"a": 1}, {"b": {"c": 2}}, {"d": ', 2), ('<think>{"x": 1}</think>[{"a": 1}]', 1), ("", 0), (None, 0)])
def test_salvage(raw, n):
    assert len(records.salvage(raw)) == n


def test_split_page():
    parts = records.split_page("HEADING\n\n" + "\n\n".join(f"block {i} 1 2 3" for i in range(6)))
    assert len(parts) > 2 and all(p.startswith("HEADING") for p in parts)
    assert records.split_page(None) == []


def test_gate_and_columns(spark):
    x = spark.createDataFrame([(1, f"i{i}", 1) for i in range(26)] + [(2, "a", 1)], "b int, identifier string, page int")
    got = {r.b: r.error for r in records.bundle_gate(x, ["b"]).collect()}
    assert "25 unique identifiers" in got[1] and got[2] is None
    y = records.disambiguate_columns(spark.createDataFrame([(1, "Flow", "max"), (1, "flow", "min"), (1, "BOD", "max")], "t int, parameter string, column_label string"), ["t"])
    assert {r.parameter for r in y.collect()} == {"Flow (max)", "flow (min)", "BOD"}


def test_vocabulary(spark):
    rows = [("BOD", "mg/l", "the BOD was 5", "bod", "concentration"), ("bod", "lbs", "bod load 7", "bod", "concentration"), ("Flow", "MGD", "flow of 2", "flow", "rate"), ("ghost", "", "no such word", None, None)]
    got = {r.term: r for r in vocabulary.build(spark.createDataFrame(rows, "parameter string, unit string, source_text string, substance string, measure string")).collect()}
    assert set(got) == {"bod", "flow"} and got["bod"].substance is None and got["flow"].measure == "rate" and got["bod"].aliases == ["BOD", "bod"]
    t = spark.createDataFrame([("BOD", ["b.o.d."]), ("B O D", [])], "canonical string, aliases array<string>")
    assert [(r.key, r.n) for r in vocabulary.collisions(t).collect()] == [("b o d", 2)]
    s = spark.createDataFrame([("a", 60, ["x"]), ("b", 1, ["x", "y"])], "term string, n int, strata array<string>")
    d = vocabulary.done(vocabulary.strata_coverage(s, spark.createDataFrame([("x",), ("y",), ("z",)], "stratum string"))).first()
    assert not d.done and d.unjudged == ["y", "z"]
    pages = spark.createDataFrame([(1, "the total flow of sewage")], "page_id int, text string")
    terms = spark.createDataFrame([("total flow", "water", 1), ("flow", "water", 5), ("ozone", "air", 9)], "canonical string, domain string, readings_covered int")
    assert {r.canonical for r in vocabulary.for_prompt(pages, terms, 2).collect()} == {"total flow", "flow"}


def test_citations(spark):
    words = [{"text": w, "x0": 10 * i, "y0": 100, "x1": 10 * i + 8, "y1": 110} for i, w in enumerate("The daily flow was 12 units.".split())]
    assert citations.crop(words, "daily flow was", 1000, 1000) == {"x": 0, "y": 88, "w": 70, "h": 34, "kind": "quote"}
    assert citations.crop(words, "not here at all", 1000, 1000) is None
    assert [w["text"] for w in citations.label_run(words, "Daily FLOW r low")] == ["daily", "flow"]
    rec = spark.createDataFrame([(1, "daily flow was"), (2, "x")], "page int, quote string")
    pages = spark.createDataFrame([(1, words, 1000, 1000)], "page int, words array<struct<text: string, x0: int, y0: int, x1: int, y1: int>>, width int, height int")
    assert {r.page: (r.box.kind, r.box.x) for r in citations.cite(rec, pages, ["page"]).collect()} == {1: ("quote", 0), 2: ("page", None)}


def test_story_of_a_place(spark):
    schema = "place string, facility string, parameter string, unit string, value double, stream string, kind string, period string, confidence double, ord int"
    rows = [("Elora", "Elora WPCP", "Daily flow", "MGD", 2.0 + y, "raw", "observation", str(1960 + y), 0.9, y) for y in range(7)] + [("Elora", "Elora WPCP", "Daily flow", "mg/L", 2.0, "raw", "observation", "1970", 0.9, 9)]
    points = views.reading_series(spark.createDataFrame(rows, schema))
    assert points.count() == 7 and points.first().series_unit == "gal/day"
    r = views.story(points).first()
    assert (r.first_year, r.last_year, r.direction, r.ok) == (1960, 1966, "increasing", True)


def test_frontier(spark):
    read = spark.createDataFrame([("Elora", 1960), ("Elora WPCP", 1961)], "place string, year int")
    links = spark.createDataFrame([("Grand", "Elora", "Galt"), ("Grand", "Galt", "Paris")], "watercourse string, upstream string, downstream string")
    held = spark.createDataFrame([("Galt", y) for y in range(1960, 1968)] + [("elora", 1960)], "place string, year int")
    got = {(r.kind, r.subject): (r.needs, r.have) for r in views.frontier(read, links, held).collect()}
    assert got[("downstream", "Elora -> Galt")] == (["Galt"], ["Elora"]) and got[("river", "Grand")] == (["Galt", "Paris"], ["Elora"])
    assert got[("trend", "Galt")] == (["Galt"], []) and ("silence", "Galt") in got and ("silence", "elora") not in got
    assert [k for k in got if k[0] == "decision"] == [("decision", "Elora")]
