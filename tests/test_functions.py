import pytest
from pyspark.sql import functions as F

from ledgerline.functions import keys, numerals, text, units


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("value,want", [(104.0, "104"), (1.5, "1.5"), (-0.0, "0"), (1e-5, "1e-05"), (0.00025, "0.00025"), (2.5e20, "2.5e+20"), (0.1, "0.1")])
def test_number_text(spark, value, want):
    assert one(spark, keys.number_text("v"), v=value) == want


def test_slug_and_record_key(spark):
    assert one(spark, keys.slug("v"), v="  Éau & Sewage -- No. 2 ") == "au-sewage-no-2"
    base = {c: "" for c in ("kind", "parameter", "unit", "qualifier", "stream", "place", "facility", "period", "identifier", "condition")}
    a = one(spark, keys.record_key(), **base, value=1.0, page=3)
    assert len(a) == 20
    assert a != one(spark, keys.record_key(), **base | {"condition": "dry"}, value=1.0, page=3)
    assert a == one(spark, keys.record_key(), **base | {"stream": "unknown"}, value=1.0, page=3)


@pytest.mark.parametrize("name,ok", [("abc.1", True), ("con", False), ("COM1.txt", False), ("../x", False), ("", False)])
def test_safe_identifier(spark, name, ok):
    assert one(spark, keys.safe_identifier("v"), v=name) is ok


@pytest.mark.parametrize(
    "raw,base,multiplier",
    [("mg/L", "mg/l", 1.0), ("ug/l", "mg/l", 1e-3), ("MGD", "gal/day", 1e6 * 1.20095), ("million gallons", "gal", 1e6), ("imp. gallons per day", "gal/day", 1.20095), ("lbs/day", "lb/day", 1.0), ("gallon per day", None, None), ("", None, None), ("°C", "c", 1.0), ("mg", None, None)],
)
def test_units(spark, raw, base, multiplier):
    q = one(spark, units.parse_unit("v"), v=raw)
    assert (q.base, pytest.approx(q.multiplier)) == (base, multiplier) if base else q is None


def test_bare_mg_needs_the_parameter_and_old_gallons_are_flagged(spark):
    assert one(spark, units.parse_unit("v", flow="f"), v="mg", f="rate").base == "gal/day"
    assert one(spark, units.parse_unit("v", flow="f"), v="mg", f="total").base == "gal"
    q = one(spark, units.parse_unit("v", era="y"), v="gallons", y=1965)
    assert q.multiplier == 1.0 and "NOT converted" in q.assumptions[0]


def test_comparable_says_why(spark):
    r = one(spark, units.comparable(units.parse_unit("a"), units.parse_unit("b")), a="mg/L", b="MGD")
    assert not r.ok and "is a concentration" in r.reason
    assert one(spark, units.comparable(units.parse_unit("a"), units.parse_unit("b")), a="ppm", b="mg/l").ok


@pytest.mark.parametrize("phrase,value", [("twenty-two", 22), ("three million", 3e6), ("two and a half million", 2.5e6), ("quatre-vingt-dix", 90), ("soixante-quinze", 75), ("mille", 1000), ("one hundred and five", 105), ("the river", None), ("", None)])
def test_words_to_number(phrase, value):
    assert numerals.words_to_number(phrase) == value


def test_scan_places_numbers():
    found = numerals.scan("a flow of about three million gallons and two pumps")
    assert [(x["value"], x["approximate"]) for x in found] == [(3e6, True), (2, False)]


def test_evidence_tokens_keep_meaning(spark):
    assert one(spark, text.evidence_tokens("v"), v="Flow, 1,200.50 ≤ 5% O’Neil") == ["word:flow", "number:1200.5", "semantic:<=", "number:5", "semantic:%", "word:o'neil"]


@pytest.mark.parametrize("page,quote,ok", [("the flow was\n12 units.", "flow was 12", True), ("flow was 12%", "flow was 12", False), ("flow was > 5", "5", False), ("flow was 120", "flow was 12", False), ("x", "", False), ("12% then 12 left", "12", True)])
def test_contains_run(spark, page, quote, ok):
    assert one(spark, text.contains_run(text.evidence_tokens("p"), text.evidence_tokens("q")), p=page, q=quote) is ok


def test_numbers_and_years(spark):
    assert one(spark, text.numbers_in("v"), v="1,442.50 gal and 2 million") == [1442.5, 2.0, 2e6]
    assert one(spark, text.infer_year("v"), v="Annual report 1968-1970").year == 1970
    assert one(spark, text.infer_year("v"), v="Report") is None
    assert one(spark, text.period_risk(F.col("q"), F.col("p")), q="higher than in 1967", p="1968").others == ["1967"]
    assert one(spark, text.language_codes("v"), v="French; eng") == ["fre", "eng"]


def test_routes(spark):
    prose = "The treatment plant at this town discharged about 104 mg/L in that year of report.\n" * 3
    cases = [(prose, ["prose"]), ("map scale 1: legend", ["map"]), ("short", ["skip"]), ("1 2 3 4 5 6\n" * 20, ["table"])]
    for page, want in cases:
        s = spark.createDataFrame([(page,)], "t string").select(text.page_signals("t").alias("s"))
        assert s.select(text.page_routes("s").alias("r")).first().r == want


def test_watercourse(spark):
    assert one(spark, text.watercourse("v"), v="Grand River at Galt") == "GRAND RIVER"
    assert one(spark, text.watercourse("v"), v="Galt station") is None
