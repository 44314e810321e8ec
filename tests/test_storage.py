import json

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import evidence
from ledgerline.sources import readers, writers

ITEM = "key string, v int, ord int"


def test_merge_is_one_transaction(spark, tmp_path):
    path = str(tmp_path / "t")
    first = writers.merge(spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 3)], ITEM), path)
    assert {(r.key, r.v) for r in first.collect()} == {("a", 1), ("b", 3)}
    assert writers.merge(spark.createDataFrame([("a", 9, 1)], ITEM), path).count() == 0
    assert {r.key for r in writers.merge(spark.createDataFrame([("a", 9, 1), ("c", 4, 2)], ITEM), path).collect()} == {"c"}
    assert spark.read.parquet(path).count() == 3 and sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["t"]
    with writers.transaction(spark, path), pytest.raises(TimeoutError):
        writers.transaction(spark, path, wait=0.2).__enter__()


def test_files_are_created_once(spark, tmp_path):
    path = str(tmp_path / "c.json")
    assert writers.create_new(spark, path, b"one") and not writers.create_new(spark, path, b"two")
    assert (tmp_path / "c.json").read_bytes() == b"one"
    assert writers.free_path(spark, str(tmp_path), "c").endswith("/c-2.json") and writers.free_path(spark, str(tmp_path), "d").endswith("/d.json")


def test_submission(spark, tmp_path):
    quote = "the average flow was 3.12 million gallons"
    rows = [("i", 1, quote, 3.12, "average flow"), ("i", 1, quote, 3.12, "at night"), ("i", 1, quote, 9.0, None), ("i", 2, quote, 3.12, None)]
    records = spark.createDataFrame(rows, "identifier string, page int, quote string, value double, condition string")
    pages = spark.createDataFrame([("i", 1, "In 1960 the average flow was 3.12 million gallons. It rained.")], "identifier string, page int, text string")
    got = writers.submit(records, pages, str(tmp_path / "c"))
    assert sorted(s for _, _, s in got) == [False, False, True, True]
    stored = [json.loads(p.read_text()) for p in (tmp_path / "c").glob("*.json")]
    assert sorted(str(d["records"][0].get("condition")) for d in stored) == ["None", "average flow"]
    assert not any(s for _, _, s in writers.submit(records, pages, str(tmp_path / "c")))
    back = readers.contributions(spark, str(tmp_path / "c" / "*.json"))
    assert {r.source for r in back.collect()} == {"person"} and back.count() == 2


def test_claims_of_three_sources(spark, tmp_path):
    one = {"kind": "observation", "parameter": "BOD", "value": 1.0, "place": "Elora", "provenance": {"identifier": "i", "page": 1, "source_text": "q"}}
    (tmp_path / "r").mkdir(), (tmp_path / "c").mkdir(), (tmp_path / "v").mkdir()
    (tmp_path / "r" / "a.json").write_text(json.dumps({"place": "Elora", "records": [one, one, one | {"value": 2.0}]}))
    (tmp_path / "c" / "b.json").write_text(json.dumps({"claim_id": "x", "records": [one | {"value": 1}, one | {"value": 3.0}]}))
    (tmp_path / "v" / "v.json").write_text(json.dumps({"p1": {"records": [one | {"value": 4.0}]}, "p2": {"error": "bad", "records": [one]}}))
    got = readers.public_claims(readers.extraction_records(spark, str(tmp_path / "r" / "*")), readers.vision_trial(spark, str(tmp_path / "v" / "*")), readers.contributions(spark, str(tmp_path / "c" / "*")))
    assert {(r.value, r.source, r.contributor) for r in got.collect()} == {(1.0, "extraction", "anonymous"), (2.0, "extraction", "anonymous"), (4.0, "extraction", "vision"), (3.0, "person", "anonymous")}


def test_vocabulary_round_trip(spark, tmp_path):
    terms = spark.createDataFrame([("bod", "bod", "concentration", "water", ["bod5"], ["mg/L"], 7, True), ("flow", "", "", "water", [], [], 9, False)], readers.TERM)
    path = str(tmp_path / "v.json")
    assert readers.vocabulary(spark, path).count() == 0
    writers.save_vocabulary(terms, path, "a note")
    assert [t["canonical"] for t in json.loads((tmp_path / "v.json").read_text())["terms"]] == ["flow", "bod"]
    assert {tuple(map(str, r)) for r in readers.vocabulary(spark, path).collect()} == {tuple(map(str, r)) for r in terms.collect()}
    with pytest.raises(ValueError, match="both be set"):
        writers.save_vocabulary(spark.createDataFrame([("x", "bod", "", "", [], [], 1, True)], readers.TERM), path)


def test_payloads_and_holdings(spark):
    x = spark.createDataFrame([('{"place": "", "records": []}',), ('{"terms": [], "stopping_rule": {}}',), ("[]",), ("nonsense",)], "j string")
    assert [r.k for r in x.select(readers.payload_kind("j").alias("k")).collect()] == ["extraction", "coverage", "other", "other"]
    items = spark.createDataFrame([("a", "British Columbia gazette: 1960", 1960), ("b", "British Columbia gazette: 1961", 1961), ("c", "Ontario gazette", 1960)], "identifier string, title string, year int")
    assert [(r.series, r.n, r.last_year) for r in readers.bc_holdings(items).collect()] == [("British Columbia gazette", 2, 1961)]


VALUES = [
    (3.12, "the flow was 3.12 MGD", "ok", ""), (3.12, "the flow was 312 MGD", "failed", None), (12.0, "it cost 3120 dollars", "failed", None), (0.05, "was .05 ppm", "ok", "reading"), (15.0, "I5 feet deep", "ok", "once OCR"), (3e6, "just over three million gallons", "ok", "the sentence states it in words"),
    (3e6, "the plants were closed", "failed", "the sentence states no number"), (None, "anything", "unchecked", "no value"), (85.0, "8,5 millions", "failed", None), (1.0, "one of the plants", "failed", "the sentence states no number"), (2500000.0, "2.5 million gallons", "ok", "reading"), (1442.0, "1,442 gallons", "ok", ""),
]


def test_value_in_quote(spark):
    x = spark.createDataFrame([(i, v, q) for i, (v, q, *_) in enumerate(VALUES)], "i int, v double, q string").select("i", evidence.value_state("v", "q").alias("s")).orderBy("i").collect()
    for r, (_, q, state, why) in zip(x, VALUES, strict=True):
        assert r.s.state == state and (why is None or r.s.why.startswith(why) and (why or not r.s.why)), (q, r.s)


def test_verdicts_of_the_page(spark):
    page = "In 1960 the average flow was > 5 and 3. 12 million gallons a day. Table 2: BOD / Effluent 15."
    rows = [
        ("the average flow was", None, "verdict"), ("the Average  flow was > 5 and 3.12 million", 3.12, "verified"), ("5 and 3.12 million gallons", 3.12, "failed"), ("flow was 3.12", 3.12, "failed"), ("3.12", 3.12, "failed"), ("a day", None, "unsupported"),
        ("the average flow was > 5", None, "unchecked"), ("table cell [BOD / Effluent]", 15.0, "failed"), ("", 1.0, "unsupported"), ("the average flow was > 5 and 3.12", 7.0, "failed"),
    ]
    rec = spark.createDataFrame([(i, "x", q, v) for i, (q, v, _) in enumerate(rows)], "i int, id string, quote string, value double")
    got = {r.i: r for r in evidence.verdicts(rec, spark.createDataFrame([("x", page)], "id string, text string"), ["id"]).collect()}
    assert [got[i].state for i in range(1, len(rows))] == [r[2] for r in rows[1:]] and got[0].state in ("unchecked", "failed")
    assert got[1].matched == "the average flow was > 5 and 3. 12 million" and "abstained" in got[7].why
    assert evidence.verdicts(rec, spark.createDataFrame([("y", page)], "id string, text string"), ["id"]).where("state <> 'unsupported'").count() == 0
    grounded = spark.createDataFrame([("each", "the beaches"), ("55 ft", "at 55 ft head"), (None, "x")], "c string, q string").select(evidence.grounded_condition("c", "q").alias("g")).collect()
    assert [r.g for r in grounded] == [None, "55 ft", None]


def test_demand_and_recovery_tables(spark, tmp_path):
    asks = spark.createDataFrame([("Élora", "1.2.3.4"), ("elora", "1.2.3.4"), ("Elora", "5.6.7.8"), (" ", "x")], "place string, peer string")
    assert writers.record_asks(asks, str(tmp_path / "d"), "s").count() == 2 and writers.record_asks(asks, str(tmp_path / "d"), "s").count() == 0
    g = spark.createDataFrame([("a", "title", 0.9, 1960, 1960), ("b", "title", 0.9, 1961, 1960)], "identifier string, basis string, confidence double, year int, truth int")
    assert [tuple(r) for r in writers.recovery_report(g.limit(1), str(tmp_path / "r")).collect()] == [("title", "high", 1, 1, 1)]
    assert [tuple(r) for r in writers.recovery_report(g, str(tmp_path / "r")).collect()] == [("title", "high", 2, 1, 2)]


def test_sharing_of_bundles(spark, tmp_path, capsys):
    from ledgerline import share

    quote = "the average flow was 3.12 million gallons"
    record = {"kind": "observation", "parameter": "flow", "value": 3.12, "unit": "MGD", "place": "Elora", "confidence": 0.9, "provenance": {"identifier": "i", "page": 1, "source_text": quote}}
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "a.json").write_text(json.dumps({"place": "Elora", "records": [record, record, record | {"period": "1961"}]}))
    assert share.main(["export", str(tmp_path / "lib"), str(tmp_path / "b"), "--contributor", "me"], spark) == 0
    assert share.main(["read", str(tmp_path / "b")], spark) == 0 and "'n_records': 2" in capsys.readouterr().out
    spark.createDataFrame([("i", 1, "In 1960 " + quote + ".")], "identifier string, page int, text string").write.parquet(str(tmp_path / "p"))
    share.main(["import", str(tmp_path / "b"), str(tmp_path / "p"), str(tmp_path / "table")], spark)
    assert "'accepted': True} 2" in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "table")).count() == 2
    share.main(["import", str(tmp_path / "b"), str(tmp_path / "p"), str(tmp_path / "table")], spark)
    assert "'accepted': True} 0" in capsys.readouterr().out
    bad = spark.read.parquet(str(tmp_path / "b" / "records")).withColumn("value", F.lit(9.0))
    counts, fresh = share.take_in(bad, spark.read.parquet(str(tmp_path / "p")), str(tmp_path / "table"))
    assert counts.first().failed == 2 and fresh.count() == 0
