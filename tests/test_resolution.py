import pytest

from ledgerline.functions import dating
from ledgerline.functions.parameters import resolve, same_measurement, with_parameter
from ledgerline.operators import places



NAMES = [
    ("BOD removal efficiency", "%", "bod|removal"),
    ("BOD removal", "mg/L", "bod|removal"),
    ("CUBIC FEET AIR PER LB BOD REMOVED", None, None),
    ("natural gas production", None, "natural gas|concentration"),
    ("Daily flow", "million gallons", "flow|rate"),
    ("flow", "million gallons", "flow|total"),
    ("maximum 24 hour flow", None, "flow|rate|maximum"),
    ("BOD objective exceeded", "%", "bod|frequency"),
    ("enrolment", None, "enrolment|count"),
    ("BOD removal (primary section)", "%", "bod|removal||primary"),
    ("", None, None),
    ("furlongs", None, None),
]


def test_resolver(spark):
    x = spark.createDataFrame(NAMES, "name string, unit string, want string").select("*", resolve("name", "unit").alias("p")).collect()
    assert [(r.name, r.p and r.p.key) for r in x] == [(n, k) for n, _, k in NAMES]
    assert {r.name: r.p.label for r in x if r.p}["maximum 24 hour flow"] == "maximum flow rate"


def test_same_measurement(spark):
    rows = [("BOD", "mg/L", "biochemical oxygen demand", "ppm", True), ("BOD", "%", "BOD", "mg/L", False), ("furlongs", None, " Furlongs", None, True), ("furlongs", None, "BOD", None, False)]
    x = spark.createDataFrame(rows, "a string, ua string, b string, ub string, want boolean")
    assert all(r.same == r.want for r in x.withColumn("same", same_measurement("a", "ua", "b", "ub")).collect())


def test_scope_from_the_sentence_and_join_back(spark):
    rows = [("BOD removal", "%", "in the primary section of the plant"), ("BOD removal", "%", "of the plant"), (None, None, None), ("BOD removal", "%", "of the plant")]
    x = with_parameter(spark.createDataFrame(rows, "parameter string, unit string, quote string"), context="quote").collect()
    assert sorted(str(r.resolved and r.resolved.key) for r in x) == ["None", "bod|removal", "bod|removal", "bod|removal||primary"]


@pytest.fixture(scope="module")
def dimensions(spark):
    galt = (["Galt"], "Galt", "city", 43.4, -80.3, "Cambridge", "merged into Cambridge", "Point of the old centre.", 1915, 1972, [("town", None, 1914), ("city", 1915, None)], None)
    york = (["York"], "York", "borough", 43.7, -79.4, None, "part of Metro", None, None, None, None, [("York East", "township", 43.6, -79.3, None, "a township", None, None, 1966, None)])
    history = spark.createDataFrame([galt, york], places.HISTORY)
    aliases = spark.createDataFrame(
        [
            (["G'alt Plant"], "Galt", None, None, None, None, None, 0.8, "Plant title."),
            (["Burlington Elizabeth Gardens"], "Burlington Elizabeth Gardens", "9", None, None, None, None, 0.88, None),
            (["Joint Area"], "Joint Area", None, None, "unknown", None, None, None, "Two towns."),
        ],
        places.ALIASES,
    )
    town = lambda i, name, term, code, lat, decided="1950-01-01", category="Populated Place": (i, name, term, category, code, lat, -80.0, "", decided)
    gazetteer = spark.createDataFrame(
        [
            town("1", "Élora", "Village", "VILG", 43.7), town("2", "Paris", "Town", "TOWN", 1.0), town("3", "Paris", "Town", "TOWN", 3.0), town("4", "Perth", "Town", "TOWN", 5.0), town("5", "Perth", "Railway Point", "RAIL", 6.0),
            town("6", "Bath", "Village", "VILG", 7.0, "1999-05-05"), town("7", "Smith", "Township", "MUN2", 8.0, category="Administrative Area"), town("8", "Smith", "Geographic Township", "GEOG", 9.0, category="Administrative Area"),
            town("9", "Elizabeth Gardens", "Community", "UNP", 10.0), town("10", "Burlington", "City", "CITY", 11.0), town("11", "Oak", "Geographic Township", "GEOG", 1.0, category="Administrative Area"), town("12", "Oak", "Geographic Township", "GEOG", 2.0, category="Administrative Area"),
        ],
        "id string, name string, generic_term string, generic_category string, concise_code string, lat double, lon double, location string, decision_date string",
    )
    return history, aliases, gazetteer, ["January", "the plant"]


def test_places_by_era(spark, dimensions):
    rows = [
        (1, "GALT", 1960), (2, "galt", 1980), (3, "G'alt plant", 1960), (4, "Elora", 1960), (5, "Paris", 1960), (6, "January", 1960), (7, None, 1960), (8, "Galt", None), (9, "Galt", 1900), (10, "York", 1960), (11, "York", 1970),
        (12, "Cambridge ( Galt )", 1960), (13, "Perth: Water  Treatment Plant and", 1970), (14, "Smith Twp", 1970), (15, "Township of Oak", 1970), (16, "Nowhere township", 1970), (17, "Bath", 1960), (18, "Perth", 1970), (19, "Nowhere", 1970), (20, "  ", 1970),
        (21, "Joint  Area", 1970), (22, "The Plant, water supply system and", 1970), (23, "Burlington Elizabeth Gardens", None), (1, "GALT", 1960),
    ]
    asked = spark.createDataFrame(rows, "id int, place_name string, year int")
    got = {r.id: r.place for r in places.resolve_places(asked, "place_name", "year", *dimensions).collect()}
    assert len(got) == 23 and [i for i, p in got.items() if p is None] and {i for i, p in got.items() if p is None} == {6, 7, 19, 20, 22}
    assert (got[1].canonical, got[1].confidence, got[1].superseded_by, got[1].kind) == ("Galt", 0.99, "Cambridge", "city")
    assert got[1].note == "Galt was a separate city in 1960; it was later merged into Cambridge. Point of the old centre."
    assert got[2].confidence == 0.9 and got[2].note.startswith("Galt no longer existed as a separate city in 1980; it was merged into Cambridge.")
    assert got[9].confidence == 0.65 and got[9].kind == "town" and got[9].note.startswith("Galt did not exist as a town in 1900")
    assert got[8].note.startswith("Merged into Cambridge.") and got[8].as_of_year is None
    assert (got[10].canonical, got[10].lat) == ("York East", 43.6) and (got[11].canonical, got[11].note) == ("York", "York was valid in 1970; it was part of Metro.")
    assert got[12].note.endswith("The title preserves the Galt locality within Cambridge.")
    assert (got[3].canonical, got[3].confidence) == ("Galt", 0.8) and got[3].note.endswith("Plant title.")
    assert (got[4].lat, got[4].kind, got[4].confidence) == (43.7, "village", 0.96)
    assert got[5].confidence == 0.35 and got[5].lat is None and "2 equally plausible" in got[5].note
    assert got[13].confidence == round(0.9 * 0.96, 4) and got[13].canonical == "Perth" and got[13].note.endswith("Recovered from a truncated water treatment plant document title.")
    assert (got[14].canonical, got[14].confidence, got[14].kind) == ("Smith Township", 0.99, "township")
    assert got[15].confidence == 0.35 and "2 township candidates" in got[15].note and "no matching Ontario township" in got[16].note
    assert got[17].confidence == 0.85 and "dated 1999" in got[17].note
    assert got[18].confidence == 0.9 and got[18].note == "Selected the CGNDB town among 2 Ontario populated features with this name."
    assert got[21].canonical == "Joint Area" and got[21].confidence == 0.4 and (got[23].lat, got[23].confidence) == (10.0, 0.88)
    assert places.dimension_problems(*dimensions[:3]).count() == 0


def test_scope_of_a_file(spark, dimensions):
    rows = [
        (1, "Perth Water Treatment Plant", "Perth", None), (2, "Elora", "Perth", None), (3, "Site 1", "Perth", "Main works"), (4, None, "Perth", None), (5, "perth", "Perth", None), (6, "X", None, None),
        (7, "Elizabeth Gardens", "Burlington Elizabeth Gardens", None), (8, "Galt", "G'alt Plant", None),
    ]
    records = spark.createDataFrame([(*r, "1960-05") for r in rows], "id int, place string, file_place string, facility string, period string")
    got = {r.id: (r.place, r.facility, r.reported_place) for r in places.scope_records(records, *dimensions).collect()}
    assert got == {
        1: ("Perth", "Perth Water Treatment Plant", "Perth Water Treatment Plant"), 2: ("Elora", None, None), 3: ("Perth", "Main works", "Site 1"), 4: ("Perth", None, None), 5: ("Perth", None, "perth"), 6: ("X", None, None),
        7: ("Burlington Elizabeth Gardens", "Elizabeth Gardens", "Elizabeth Gardens"), 8: ("G'alt Plant", "Galt", "Galt"),
    }


def test_facility_key(spark):
    rows = [("Belleville water  pollution control plant", "Belleville"), ("The water pollution control plant", "Belleville"), ("Works of Galt Galt", "galt"), (None, "x"), ("Drury Lane", None)]
    x = spark.createDataFrame(rows, "f string, p string").select(places.facility_key("f", "p").alias("k")).collect()
    assert [r.k for r in x] == ["water pollution control plant", "water pollution control plant", "works", "", "drury lane"]


def test_subunits(spark):
    rows = [(1, "d", "Main Plant"), (2, "d", "Main  Plant"), (3, "d", "Other"), (4, "d", "Unit No. 2"), (5, "e", "digester"), (6, None, "Works"), (7, None, "pump 3a"), (8, "d", "Pump house")]
    x = places.attach_subunits(spark.createDataFrame(rows, "ord int, identifier string, facility string")).collect()
    assert {r.ord: r.parent_facility for r in x} == {1: None, 2: None, 3: None, 4: "Main Plant", 5: None, 6: None, 7: "Works", 8: None}


LETTER = """Ottawa, March 4, 1971
The Honourable Minister
I have the honour to submit the report for the fiscal year 1970.
Yours truly"""
DATED = [
    (["Queen's Printer for Ontario, 1969"], 1969, "publication line", 0.94),
    (["© Crown 1971\nAnnual report 1969"], 1971, "copyright line", 0.96),
    (["Annual Report for the year 1965"], 1965, "annual report period", 0.76),
    (["Annual Report 1964-1965"], 1965, "annual report period", 0.72),
    (["Annual Report 1965", "Annual Report 1967"], None, "conflicting evidence", 0.0),
    (["R.S.O. 1970 applies", "x"], None, "no defensible date", 0.0),
    (["Copyright Act 1970", "Published 1999 copies", "Contract No. 1962", "1959 King Street"], None, "no defensible date", 0.0),
    (["", None], None, "no defensible date", 0.0),
    ([LETTER], 1971, "covering letter", 0.83),
    (["WATER WORKS", "June 1962", "x"], 1962, "title page", 0.84),
    (["Toronto\nJune 4, 1962"], 1962, "front matter date", 0.80),
    (["MINUTES of Council\nJune 4, 1962"], None, "no defensible date", 0.0),
    (["Published 1960\nRevised 1964"], 1964, "publication line", 0.94),
    (["Published 1960\nPrinted 1964"], None, "conflicting evidence", 0.0),
    (["June 1960", "Annual Report 1965"], None, "conflicting evidence", 0.0),
    (["June 1965", "Annual Report 1964"], 1965, "title page", 0.84),
    (["Table 1 Flows\n1961  3.1  4\n1962  3.4  5\n1963  3.9  6"], 1963, "latest data year (lower bound)", 0.30),
    (["Published 1960\nTable 1 Flows\n1961  3.1  4\n1962  3.4  5\n1963  3.9  6"], None, "conflicting evidence", 0.0),
    (["Table 1 Projected flows\n1961  3.1  4\n1962  3.4  5\n1963  3.9  6"], None, "no defensible date", 0.0),
    (["x"] * 14 + ["Published 1969"], None, "no defensible date", 0.0),
    (["Digitized by the Internet Archive 2011"], None, "no defensible date", 0.0),
    (["Received 4 June 1962"], None, "no defensible date", 0.0),
]


def test_dating(spark):
    pages = [(str(i), n + 1, t) for i, (texts, *_) in enumerate(DATED) for n, t in enumerate(texts)]
    got = {r.identifier: r for r in dating.date_documents(spark.createDataFrame(pages, "identifier string, page int, text string")).collect()}
    assert [(i, got[str(i)].year, got[str(i)].basis, got[str(i)].confidence) for i in range(len(DATED)) if (got[str(i)].year, got[str(i)].basis, got[str(i)].confidence) != DATED[i][1:]] == []
    assert got["8"].alternatives == [1970] and got["4"].alternatives == [1965, 1967] and "Honourable" in got["8"].evidence


def test_dating_of_poor_scans(spark):
    x = spark.createDataFrame([("a", 2, "Annual Report 1960", 0.9), ("a", 1, "Published 1961", 0.4), ("b", 1, None, 0.1)], "identifier string, page int, text string, ocr_confidence double")
    got = {r.identifier: (r.year, r.confidence, r.alternatives) for r in dating.date_documents(x).collect()}
    assert got == {"a": (1961, 0.6, [1960]), "b": (None, 0.0, [])}
