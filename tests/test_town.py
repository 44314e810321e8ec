import pytest
from pyspark.sql import functions as F

from ledgerline.operators import batches, narrate, network, sampling, series, town, vocabulary

RECORD = "ord int, place string, facility string, parameter string, unit string, value double, stream string, kind string, period string, confidence double, qualifier string, condition string, identifier string, page int, source_text string, parent_facility string"


def record(i, place="Elora", facility="Works", parameter="BOD removal", unit="%", value=50.0, stream="effluent", kind="observation", period="1960", confidence=0.9, identifier="d1", page=1, quote="the sentence", parent=None):
    return (i, place, facility, parameter, unit, value, stream, kind, period, confidence, None, None, identifier, page, quote, parent)


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        record(1), record(2, period="1961", value=60.0), record(3, period="1961", value=70.0, confidence=0.5), record(4, period="1962", value=0.4, unit="mg/L", parameter="BOD"), record(5, period="1963", value=1.0, unit="furlongs", parameter="oddity"),
        record(6, place="Elora Water Pollution Control Plant", period="1964", value=80.0), record(7, period="1960"), record(8, kind="design", parameter="horsepower", unit="hp", value=60.0, facility="Unit No. 1", parent="Plats"),
        record(9, kind="design", parameter="horsepower", unit="hp", value=60.0, facility="Unit No. 1", parent="Plats", page=7), record(10, kind="design", parameter="horsepower", unit="hp", value=30.0, facility="Unit No. 2", parent="Plats"),
        record(11, kind="standard", parameter="BOD", unit="mg/L", value=15.0, facility=None), record(12, place="Paris", facility="Other", period="x", value=3.0), record(13, place="Elora", facility="Second works", period="1970", value=40.0),
    ]
    return spark.createDataFrame(rows, RECORD)


def test_rows_of_a_town(records):
    listed = {r.ord: r for r in town.rows(records).collect()}
    assert sorted(listed) == [1, 2, 3, 4, 5, 6, 12, 13]  # 7 repeats 1; other kinds take no part
    assert {i: listed[i].outcome for i in listed} == {1: "series", 2: "series", 3: "series", 6: "series", 4: "single", 5: "bare", 12: "bare", 13: "single"}
    assert [listed[i].charted for i in (1, 2, 3, 6)] == [True, True, False, True] and listed[6].town == "elora" and listed[1].label == "bod removal"


def test_panels_systems_and_singles(records):
    listed = town.rows(records)
    panel = town.panels(listed).collect()
    assert [(p.town, p.label, p.n, p.first_year, p.last_year, p.low, p.high, p.plain) for p in panel] == [("elora", "bod removal", 4, 1960, 1964, 50.0, 80.0, "bod removal (biochemical oxygen demand)")]
    assert [tuple(x) for x in panel[0].lines[0].points] == [(1960, 50.0), (1961, 60.0), (1964, 80.0)]
    assert [(s.facility_group, s.title, s.n) for s in town.systems(town.panels(listed)).collect()] == [("works", "Works", 4)]
    alone = {(r.town, r.label, r.facility_group): (r.outcome, r.shelf) for r in town.singles(listed).collect()}
    assert alone[("elora", "oddity", "works")] == ("bare", "") and alone[("elora", "bod", "works")][0] == "single" and len(alone) == 4
    page = {r.town: r for r in town.page(records, records.sparkSession.createDataFrame([("Grand", "Elora", "Paris")], "river string, upstream string, downstream string")).collect()}
    assert (page["elora"].n_charted, page["elora"].n_measurements, page["elora"].n_listed, page["elora"].downstream, page["paris"].upstream) == (4, 7, 3, ["Paris"], ["Elora"])


def test_subjects_and_restatements(records):
    found = {(r.works, r.unit_name, r.value): r for r in town.subjects(records).collect()}
    assert set(found) == {("Plats", "Unit No. 1", 60.0), ("Plats", "Unit No. 2", 30.0), (town.NO_SUBJECT, "", 15.0)}
    assert [r.page for r in found[("Plats", "Unit No. 1", 60.0)].restatements] == [7] and found[("Plats", "Unit No. 2", 30.0)].title == "What it was built for"
    assert [(r.with_subject, r.without_subject) for r in town.attribution(town.subjects(records)).collect()] == [(2, 1)]


def test_summary_of_a_town(records):
    x = {r.place: r for r in town.summary(records).collect()}["Elora"]
    assert (x.facility, x.span, x.n_measurements) == ("Works", [1960, 1963], 6) and "Second works" in x.other_facilities and x.sources == ["d1"]
    assert [m.n for m in x.measured][:1] == [4]


def test_same_town_and_labels(spark):
    x = spark.createDataFrame([("Owen Sound Sewage Treatment Plant",), ("owen sound",), ("Owen Soundings",), (None,)], "p string")
    assert [r.s for r in x.select(town.same_town("p", ["Owen Sound"]).alias("s")).collect()] == [True, True, False, False]
    labels = spark.createDataFrame([("BOD",), ("SS removal",), ("flow",)], "l string").select(town.plain_label("l").alias("p")).collect()
    assert [r.p for r in labels] == ["BOD (biochemical oxygen demand)", "SS removal (suspended solids)", "flow"]


def test_sentences(spark):
    t = spark.createDataFrame([("a", float(i), 10.0 + 2 * i, 0.9) for i in range(8)] + [("b", 1.0, 1.0, 0.9)], "k string, t double, v double, c double")
    said = {r.k: r.s for r in series.trend(t, ["k"]).select("k", narrate.trend_sentence().alias("s")).collect()}
    assert said["a"].startswith("increasing +2/yr (90% CI +2 to +2, n=8, p=0.00") and said["b"] == "no trend computed: only 1 readings; need 6"
    years = spark.createDataFrame([("Elora", y) for y in (1960, 1961, 1965)], "place string, year int")
    assert series.silence(years, ["place"], horizon=1970).select(narrate.silence_sentence("place").alias("s")).first().s == "Elora: 3 reports 1960-1965 (50% continuity), longest interior gap 3 yr, SILENT since 1966"
    pair = spark.createDataFrame([("g", 1960 + i, float(i)) for i in range(6)], "k string, year int, v double")
    said = network.influence(pair, pair.withColumn("v", -F.col("v")), ["k"]).select(narrate.influence_sentence(F.lit("A"), F.lit("B"), F.lit("bod")).alias("s")).first().s
    assert said.startswith("A effluent vs B influent (bod, 6 shared years): rank correlation -1.00 — they move oppositely.")
    assert "not reportable — only 2 shared years" in network.influence(pair.limit(2), pair.limit(2), ["k"]).select(narrate.influence_sentence(F.lit("A"), F.lit("B"), F.lit("bod")).alias("s")).first().s
    assert [r.c for r in spark.createDataFrame([(1.0,), (20.0,), (21.0,), (None,)], "km double").select(narrate.plant_confidence("km").alias("c")).collect()] == ["likely", "possible", "weak", "not placed"]


def test_explained_numbers(spark):
    rows = [("BOD", 50.0, "mg/L", None, None, None, None), ("BOD", 10.0, "mg/L", None, None, None, None), ("BOD removal", 40.0, "%", None, None, None, None), ("BOD", 20.0, "mg/L", 15.0, None, None, 1965), ("BOD", 20.0, "mg/L", None, 10.0, 30.0, 1965), ("oddity", 1.0, "x", None, None, None, None), ("flow", 5.0, "gal/day", None, None, None, None)]
    x = narrate.explain(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, parameter string, value double, unit string, era_standard double, era_low double, era_high double, era_year int")).orderBy("i").collect()
    assert x[0].verdict.startswith("50 mg/L is about 2.0 times the modern 25 mg/L benchmark") and x[0].caveat and x[1].verdict.startswith("10 mg/L is below")
    assert x[2].verdict.startswith("40% of the BOD") and x[2].compared_against is None and x[3].verdict == "20 mg/L is above the 15 mg/L limit that applied then." and x[3].caveat is None
    assert x[4].verdict == "20 mg/L is within the 10-30 range that applied in 1965." and "No plain-language entry" in x[5].explanation and x[6].verdict is None


def test_batches(spark):
    items = spark.createDataFrame([("a", "Elora annual report", "1960", 1), ("b", "Elora Annual Report", None, 2), ("c", "Elora map", "1950", 3), ("d", "Sewage treatment plant, Elora", "1955", 4), ("e", "Paris annual report", "1970", 5)], "identifier string, title string, year string, ord int")
    picked = batches.report_selection(items, spark.createDataFrame([("Elora",), ("Paris",), ("x",)], "place string"))
    assert [(r.place, r.identifier) for r in picked.orderBy("place", "at").collect()] == [("Elora", "d"), ("Elora", "a"), ("Elora", "b"), ("Paris", "e")]
    prints = {r.place: (r.n, r.fingerprint) for r in batches.selection_fingerprint(picked).collect()}
    import hashlib

    assert prints["Elora"] == (3, hashlib.sha256(b'["d","a","b"]').hexdigest())
    slugs = [r.s for r in spark.createDataFrame([("Owen Sound",), ("CON",), ("Élora / Fergus",), (" ",)], "p string").select(batches.file_slug("p").alias("s")).collect()]
    assert slugs[0] == "owen-sound" and slugs[1].startswith("con--") and slugs[2].startswith("elora-fergus--") and slugs[3] is None
    results = spark.createDataFrame([("Elora", True, False, False, 5)], "place string, valid boolean, receipt boolean, pass_seen boolean, modified int")
    assert [(r.place, r.state) for r in batches.plan(picked, results, 5).collect()] == [("Elora", "resume-unverified"), ("Paris", "new")]
    got = batches.complete(spark.createDataFrame([("Elora", "d"), ("Elora", "z")], "place string, identifier string"), picked).where("place = 'Elora'").first()
    assert (got.complete, got.missing, got.unexpected) == (False, ["a", "b"], ["z"])
    fam = spark.createDataFrame([("Annual Report 1962, Elora",)], "t string").select(batches.title_family("t").alias("a"), batches.vocabulary_family("t").alias("b")).first()
    assert (fam.a, fam.b) == ("annual report elora", "annual report elora")
    pools = batches.disjoint_pools(spark.createDataFrame([("1", "Report A 1", None), ("2", "Report A 2", 1960), ("3", "Report B", 1961), ("4", "Report B 2", 1962)], "identifier string, title string, year int"), 5, 5, 1).collect()
    assert {(r.identifier, r.pool) for r in pools if r.pool == "unknown"} == {("1", "unknown")} and [r.family for r in pools if r.pool == "validation"] == ["report b"]
    rows = spark.createDataFrame([(1.0, 2, 1, None), (3.0, 4, 4, None), (9.0, 0, 0, "x")], "seconds double, n_records int, n_in_ocr int, error string")
    t = batches.trial_summary(rows).first()
    assert (t.pages, t.errors, t.records, t.middle_seconds, t.middle_records) == (3, 1, 6, 3.0, 4) and abs(t.share_in_ocr - 5 / 6) < 1e-9
    cost = batches.cost_model(spark.createDataFrame([("gpu", 2.0, 100.0, 200.0)], "option string, usd_per_hour double, low double, high double"), 1000, 0.5, 0.8, {"text_in": 900.0, "text_out": 100.0, "vision_in": 1800.0, "vision_out": 200.0}, 0.5).first()
    assert (cost.usd_text_high, cost.usd_high) == (round(400 * 1000 / 100 / 3600 * 2), round((4000 + 100 * 2000 / 50) / 3600 * 2))
    pages = spark.createDataFrame([(f"s{i % 3}", f"d{i}", p) for i in range(12) for p in (1, 2)], "stratum string, identifier string, page int")
    assert batches.trial_pages(pages, strata=2, documents=3).groupBy("stratum").count().count() == 2 and batches.trial_pages(pages, strata=2, documents=3).count() == 6


def test_vocabulary_checks_and_survey(spark):
    terms = spark.createDataFrame([("bod", "bod", "", "water", ["bod5", "bod5"], ["mg/L"], -1, True), ("flow", "flow", "rate", "water", [""], [], 5, None), ("bod5", "bod", "concentration", "water", None, None, 3, False)], "canonical string, substance string, measure string, domain string, aliases array<string>, typical_units array<string>, readings_covered long, reviewed boolean")
    wrong = {r.problem for r in vocabulary.validation_errors(terms).collect()}
    assert {"substance and measure must both be set or both be empty", "readings_covered must be non-negative", "aliases must be unique", "aliases cannot be empty", "reviewed must be true or false", "matching key 'bod5' is claimed by: bod, bod5"} <= wrong
    got = {r.parameter: (r.term, r.known) for r in vocabulary.matched(spark.createDataFrame([("B.O.D5",), ("Flow!",), ("x",), (None,)], "parameter string"), terms).collect()}
    assert got["Flow!"] == ("flow", True) and got["x"] == (None, False) and got[None] == (None, False)
    stems = spark.createDataFrame([("Average Suspended Solids Concentration", "mg/L"), ("pupils", None)], "n string, u string").select(vocabulary.stem("n").alias("s"), vocabulary.domain_hint(F.concat_ws(" ", "n", "u")).alias("h")).collect()
    assert [(r.s, r.h) for r in stems] == [("suspended solids", "water"), ("pupils", "education")]
    readings = spark.createDataFrame([("BOD", "mg/L", "the BOD was 3", "s1", "f1", 80.0), ("BOD", "lbs", "the BOD was 3", "s1", "f2", 50.0), ("oddity", None, "nothing", "s2", "f1", None), ("widgets", None, "widgets", "s2", "f1", 40.0), ("", None, "", "s2", "", None)], "parameter string, unit string, source_text string, stratum string, family string, ocr_confidence double")
    terms = vocabulary.survey(vocabulary.observed(readings)).cache()
    by = {r.term: r for r in terms.collect()}
    assert by["bod|concentration"].archive_language and by["bod|concentration"].settled and not by["oddity"].archive_language and by["widgets"].suspect
    assert {r.term for r in vocabulary.unsettled(terms).collect()} == {"widgets"}
    assert {r.part: r.readings for r in vocabulary.survey_report(terms).collect()} == {"archive": 3, "model": 1, "archive without suspects": 1, "unsettled": 1}
    assert vocabulary.survey_controls(terms).first().model_named_share == 0.25
    planned = spark.createDataFrame([("s1",), ("s9",)], "stratum string")
    assert [r.stratum for r in vocabulary.weakest(vocabulary.strata_coverage(terms, planned)).collect()] == ["s9", "s1"]


def test_prompt_terms(spark):
    terms = spark.createDataFrame([(f"term{i}", [], "d", i) for i in range(5)] + [("suspended solids", ["floating matter"], "water", 0)], "canonical string, aliases array<string>, domain string, readings_covered long")
    pages = spark.createDataFrame([(1, "the Floating matter rose"), (2, "solids only"), (3, None)], "page_id int, text string")
    got = vocabulary.for_prompt(pages, terms, limit=3).collect()
    assert {p: {r.canonical for r in got if r.page_id == p} for p in (1, 2, 3)} == {1: {"suspended solids", "term4", "term3"}, 2: {"suspended solids", "term4", "term3"}, 3: {"term4", "term3", "term2"}}
    assert [r.phrase for r in got if r.page_id == 1 and r.canonical == "suspended solids"] == [1]


def test_frontier_queries_and_strata(spark):
    q = spark.createDataFrame([("a", "x", ["Elora"], 1.0), ("b", "y", [], 9.0), ("c", "z", ["Elora", "Paris"], 5.0), ("d", "w", [" elora "], 2.0)], "kind string, subject string, needs array<string>, value double")
    assert [r.subject for r in sampling.waiting(q).collect()] == ["w", "x", "z"] and {r.subject for r in sampling.unlocks(q, "ELORA").collect()} == {"x", "w"}
    c = spark.createDataFrame([(["g", "a"],), (["g"],), ([],), (None,)], "c array<string>").select(sampling.first_stratum("c", ["g"]).alias("s")).collect()
    assert [r.s for r in c] == ["a", "unsorted", "unsorted", "unsorted"]


def test_upstream_and_watershed(spark):
    e = [("a", "B"), ("c", "a"), ("d", "a"), ("e", "c"), ("e", "d"), ("b", "e"), ("f", "f")]
    x = spark.createDataFrame(e, "upstream string, downstream string")
    assert {(r.place, r.distance) for r in network.upstream_of(x, "b").collect()} == {("a", 1), ("c", 2), ("d", 2), ("e", 3)}
    chain = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(60)], "upstream string, downstream string")
    assert network.upstream_of(chain, "n0").count() == 60
    towns = spark.createDataFrame([("A", 43.0, -80.0), ("B", 43.5, -80.0), ("C", None, None)], "plant string, lat double, lon double")
    st = spark.createDataFrame([("g1", "GRAND", 100.0, 43.0, -80.01), ("g2", "GRAND", 300.0, 43.5, -80.01), ("g3", "GRAND", 900.0, 46.5, -80.0), ("g4", None, 1.0, 43.0, -80.0)], "gauge string, river string, area double, lat double, lon double")
    rivers, wide = network.watershed(towns, st)
    assert [(r.upstream, r.downstream, r.up_area, r.down_area) for r in rivers.collect()] == [("A", "B", 100.0, 300.0)] and [r.river for r in wide.collect()] == ["GRAND"]
