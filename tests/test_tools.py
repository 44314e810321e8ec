import pytest
from pyspark.sql import functions as F

from ledgerline.plans import tools
from ledgerline.sources import contracts

GOLD = "identifier string, page int, ord long, value double, unit string, kind string, stream string"


def test_scores_of_a_saved_run(spark):
    gold = spark.createDataFrame([("a", 1, 1, 10.0, "mg", "observation", "effluent"), ("a", 1, 2, 20.0, "mg", "design", None), ("b", 1, 1, 5.0, "mg", "observation", None)], GOLD)
    got = spark.createDataFrame([("a", 1, 1, 10.05, "mg", "observation", "influent"), ("a", 1, 2, 20.0, "mg", "observation", None), ("a", 1, 3, 99.0, "mg", "observation", None)], GOLD)
    by = {(r.identifier, r.page): r for r in tools.scores(gold, got).collect()}
    a = by["a", 1]
    assert (a.gold, a.got, a.matched, a.kind_ok, a.stream_ok, a.stream_n) == (2, 3, 2, 1, 0, 1) and by["b", 1].got == 0
    totals, skipped = tools.rescored(gold, got)
    t = totals.first()
    assert (t.precision, t.recall, t.kind_accuracy, t.stream_accuracy) == (2 / 3, 1.0, 0.5, 0.0) and [r.identifier for r in skipped.collect()] == ["b"]
    assert [(r.gold_kind, r.got_kind, r.n) for r in tools.kind_confusions(gold, got).collect()] == [("design", "observation", 1)]
    bench = {r.what: r.precision for r in tools.reader_bench(gold, got.withColumn("passed", F.col("value") < 50)).collect()}
    assert bench == {"model output": 2 / 3, "as published": 1.0}


def test_disputes_and_report(spark):
    rows = [("s1", 1.0, True, "i", 1, "q one"), ("s1", 2.0, True, "j", 1, "q two"), ("s2", 1.0, True, "i", 1, "a"), ("s2", 2.0, True, "i", 1, "b"), ("s3", 1.0, True, "i", 1, "same"), ("s3", 2.0, True, "i", 1, "Same "), ("s4", 1.0, False, "i", 1, "x")]
    x = spark.createDataFrame(rows, "slot string, value double, verified boolean, identifier string, page int, quote string")
    assert {(r.slot, r.same_sentence) for r in tools.disputed(x).collect()} == {("s1", False), ("s3", True)}
    from ledgerline.operators import ledger

    r = tools.ledger_report(ledger.slots(x)).first()
    assert (r.slots, r.undistinguished, r.unsupported) == (4, 1, 1) and r.contested == 2


def test_reviews(spark):
    p = spark.createDataFrame([("cordwood", 5, ["Cord wood", "cordwood cut"], ["cords"]), ("x", 2, [], None)], "stem string, n long, variants array<string>, units array<string>")
    f = tools.review_file(p)
    assert [r.suggested_domain for r in f.collect()] == ["forestry", None] and tools.applied_review(f).count() == 0
    done = f.withColumn("decision", F.when(F.col("proposed_term") == "cordwood", "keep")).withColumn("canonical", F.lit(" "))
    assert {tuple(r) for r in tools.applied_review(done).collect()} == {("forestry", s, "cordwood") for s in ("cord wood", "cordwood cut", "cordwood")}


def test_places_and_rivers(spark):
    rec = spark.createDataFrame([("Elora", "1960", "observation"), ("elora ", "1961-05", "design"), ("Paris", None, "observation")], "place string, period string, kind string")
    assert {r.place: r.years for r in tools.years_of(rec).collect()} == {"elora": [1960, 1961], "paris": []} and tools.held(rec, "lor").count() == 2
    s = spark.createDataFrame([("Elora", 1960, 1961, 1962), ("Galt", 1950, 1950, None)], "place string, first_year int, last_year int, silent_since int")
    at = spark.createDataFrame([("elora", 1.0, 2.0)], "place string, lat double, lon double")
    assert {r.place: (r.lat, r.extracted, r.reported) for r in tools.municipalities(s, at, rec).collect()} == {"Elora": (1.0, True, [1960, 1961]), "Galt": (None, False, [])}
    rivers = spark.createDataFrame([("G", "A", "B", 1.0, 2.0, "likely"), ("G", "B", "C", 2.0, 3.0, "possible"), ("H", "X", "Y", 1.0, 9.0, "likely")], "river string, upstream string, downstream string, up_area double, down_area double, confidence string")
    page = tools.watershed_page(rivers).collect()
    assert [(p.river, p.places, p.n_links, p.n_likely) for p in page] == [("G", ["A", "B", "C"], 2, 1), ("H", ["X", "Y"], 1, 1)]
    c = {r.place: r for r in tools.coverage_of_places(rec.withColumn("place", F.initcap(F.trim("place")))).collect()}
    assert c["Elora"].design == 1 and c["Elora"].coverage.startswith("Elora: 2 reports 1960-1961") and c["Paris"].coverage is None


def test_analysis_of_a_place(spark):
    rows = [("Elora", "Works", "BOD removal", "%", 40.0 + 3 * i, "effluent", "observation", str(1960 + i), 0.9, "q") for i in range(8)] + [("Elora", "Works", "pupils", "", 3.0, "unknown", "observation", "1960", 0.9, "q")]
    x = spark.createDataFrame(rows, "place string, facility string, parameter string, unit string, value double, stream string, kind string, period string, confidence double, source_text string").withColumn("ord", F.monotonically_increasing_id())
    a = tools.analyse(x).collect()
    assert [(r.key, len(r.points), r.ok) for r in a] == [("bod|removal", 8, True)] and a[0].trend.startswith("increasing +3/yr") and a[0].told.startswith("how much oxygen")


def test_providers_contracts_and_generations(spark, tmp_path):
    p = spark.createDataFrame([("a", 0, "https://x", "CC0", "none", None), ("b", 0, "http://x", "", "header", ""), ("c", 1, "https://x", "CC0", "header", "KEY")], "name string, tier int, endpoint string, licence string, auth_mode string, env_var string")
    assert {r.name: r.n for r in tools.provider_problems(p).groupBy("name").agg(F.count("*").alias("n")).collect()} == {"b": 3}
    assert {r.name: (r.usable, r.needs) for r in tools.provider_status(p, []).collect()} == {"a": (True, None), "b": (False, "needs a key in (not declared)"), "c": (False, "needs a key in KEY")}
    assert {r.name for r in tools.provider_status(p, ["KEY"]).where("usable").collect()} == {"a", "c"}
    for name in contracts.CONTRACTS:
        assert contracts.violations(contracts.empty(spark, name).withColumn("more", F.lit(1)), name) == []
    assert contracts.violations(spark.createDataFrame([("x",)], "url string"), "http_fetch")[0] == "status: missing"
    path = str(tmp_path / "g")
    with pytest.raises(Exception, match="current"):
        tools.current_generation(spark, path).collect()
    tools.publish_generation(spark.range(3).toDF("id"), path)
    tools.publish_generation(spark.range(5).toDF("id"), path)
    assert tools.current_generation(spark, path).count() == 5
    r = spark.createDataFrame([("i", 1, "Row", "Col", "", None, 1.0, "mg", None, None)], "identifier string, page int, row_label string, column_label string, source_text string, parameter string, value double, unit string, kind string, confidence double")
    assert tools.rejected_as_records(r).first().provenance.source_text == "table cell [Row / Col]"
