import json

from pyspark.sql import functions as F

from ledgerline import sql
from ledgerline.operators import decisions, evidence, ledger, network, sampling, scoring, search
from ledgerline.sources import readers, writers
from ledgerline.streaming import stateful


def test_slot_states(spark):
    rows = [("s", 1.0, True, "d", 1, "a"), ("s", 1.0, True, "e", 2, "b"), ("c", 1.0, True, "d", 1, "a"), ("c", 2.0, True, "e", 1, "b"), ("u", 1.0, True, "d", 1, "a"), ("u", 2.0, True, "d", 1, "b"), ("n", 1.0, False, "d", 1, "a")]
    x = ledger.slots(spark.createDataFrame(rows, "slot string, value double, verified boolean, identifier string, page int, quote string"))
    assert {r.slot: r.state for r in x.collect()} == {"s": "settled", "c": "contested", "u": "undistinguished", "n": "unsupported"}


def test_merge_is_idempotent(spark, tmp_path):
    x = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "key string, ord int, v string")
    path = str(tmp_path / "t")
    assert writers.merge(x, path).count() == 2
    assert writers.merge(x, path).count() == 0
    assert {(r.key, r.v) for r in spark.read.parquet(path).collect()} == {("a", "x"), ("b", "z")}


def test_round_robin(spark):
    x = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "g string, o int")
    assert [(r.g, r.o) for r in ledger.round_robin(x, "g", "o", 3).collect()] == [("a", 1), ("b", 1), ("a", 2)]


def test_verdicts(spark):
    rec = spark.createDataFrame([(1, "flow was 12 units", 12.0), (2, "flow was 12 units", 13.0), (3, "flow was 12 units", 12.0), (4, "the flow was large", None), (9, "gone", 1.0)], "id int, quote string, value double")
    pages = spark.createDataFrame([(i, "In all the flow was large; flow was 12 units there.") for i in (1, 2, 4)] + [(3, "nothing")], "id int, text string")
    got = {r.id: r.state for r in evidence.verdicts(rec, pages, ["id"]).collect()}
    assert got == {1: "verified", 2: "failed", 3: "failed", 4: "unchecked", 9: "unsupported"}


def test_containing(spark):
    p = spark.createDataFrame([(1, "alpha beta gamma delta five"), (2, "no such words here")], "passage_id int, text string")
    d = spark.createDataFrame([(7, "x Alpha, beta\ngamma delta FIVE y"), (8, "alpha beta gamma delta")], "page_id int, text string")
    assert [tuple(r) for r in evidence.containing(p, d).collect()] == [(1, 7)]


def test_containing_short_passages(spark):
    p = spark.createDataFrame([(1, "Beta gamma"), (2, "delta"), (3, "gamma beta"), (4, "a b c"), (5, "alpha beta gamma delta"), (6, ""), (7, None)], "passage_id int, text string")
    d = spark.createDataFrame([(7, "x Alpha, beta\nGAMMA delta y"), (8, "delta"), (9, None)], "page_id int, text string")
    assert sorted(tuple(r) for r in evidence.containing(p, d).collect()) == [(1, 7), (2, 7), (2, 8), (5, 7)]


def test_quoted_equals_its_sql(spark, tmp_path):
    import duckdb

    from ledgerline.plans import catalog

    passages = [(1, "The flow was 12 units there."), (2, "ow was"), (3, "5"), (4, "a  b\tc d"), (5, ""), (6, None), (7, "..."), (1, "The flow was 12 units there."), (None, "flow was 12"), (8, "> 5 of"), (9, " cost 5 "), (10, "no such words at all")]
    pages = ["In all The flow was 12 units there. Yes", "THE FLOW WAS 12 UNITS THERE.", "xThe flow was 12 units there.y", "was 5% of 5", "5 of 5%", "a b c d a  b\tc d", "", None, "x > 5 of", "now $ cost 5 now", "now cost 5 ...\n% now", "the cost 5 \n", "...", "%\n..."]
    pages = [(i, x) for i, x in enumerate(pages)] + [(0, pages[0]), (None, pages[0]), (None, pages[2])]
    for name, schema, rows in (("benchmark", "item_id long, text string", passages), ("documents", "doc_id long, text string", pages)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = con.execute(catalog.ORACLES["evidence_containment"]).fetchall()
    assert len(want) > 30 and sorted(map(str, want)) == sorted(str(tuple(r)) for r in catalog.evidence_containment(spark, str(tmp_path)).collect())


def test_nearest_agrees_with_all_pairs(spark):
    import random

    rng = random.Random(2)
    p = [(i, rng.uniform(43, 47), rng.uniform(-82, -78)) for i in range(30)]
    g = [(i, rng.uniform(43, 47), rng.uniform(-82, -78)) for i in range(60)]
    pd, gd = spark.createDataFrame(p, "plant int, lat double, lon double"), spark.createDataFrame(g, "gauge int, glat double, glon double")
    brute = pd.crossJoin(gd).withColumn("km", network.haversine_km("lat", "lon", "glat", "glon")).where("km <= 40").groupBy("plant").agg(F.min(F.struct("km", "gauge")).alias("m"))
    assert {(r.plant, r.gauge) for r in network.nearest(pd, gd).collect()} == {(r.plant, r.m.gauge) for r in brute.collect()}


def test_upstream_ends_in_cycles(spark):
    e = spark.createDataFrame([("B", "A"), ("C", "b"), ("A", "C")], "upstream string, downstream string")
    assert {(r.place, r.distance) for r in network.upstream_of(e, "a").collect()} == {("b", 1), ("c", 2)}


def test_influence_refuses_few_years(spark):
    up = spark.createDataFrame([("k", y, float(y)) for y in range(4)], "k string, year int, v double")
    r = network.influence(up, up, ["k"]).first()
    assert r.r is None and r.reason == "only 4 shared years"
    up = spark.createDataFrame([("k", y, float(y)) for y in range(6)], "k string, year int, v double")
    assert network.influence(up, up, ["k"]).first().r == 1.0


def test_coverage_and_wilson(spark):
    t = spark.createDataFrame([("a", n) for n in (1, 1, 1, 2, 5)], "k string, n int")
    r = sampling.coverage(t, ["k"]).first()
    assert (r.f1, r.f2, round(r.coverage, 3), r.chao1) == (3, 1, 0.7, 5 + 3 * 2 / 4)
    w = spark.range(1).select(sampling.wilson(F.lit(53), F.lit(100)).alias("w")).first().w
    assert round(w.low, 3) == 0.433 and round(w.high, 3) == 0.625


def test_allocation_keeps_to_budget():
    got = sampling.allocate({"a": 10000, "b": 100, "c": 1}, 50)
    assert sum(got.values()) <= 50 and got["c"] == 1 and got["a"] > got["b"]
    assert sampling.allocate({}, 10) == {}


def test_greedy_match_prefers_the_same_kind(spark):
    gold = spark.createDataFrame([(1, 1, 10.0, "mg", "x"), (1, 2, 10.0, "mg", "y")], "page int, ord long, value double, unit string, kind string")
    got = spark.createDataFrame([(1, 1, 10.05, "mg", "y")], "page int, ord long, value double, unit string, kind string")
    assert [(r.gold_ord, r.got_ord) for r in scoring.greedy_match(gold, got, ["page"]).collect()] == [(2, 1)]


def test_greedy_match_of_many_pages(spark):
    """Pages follow each other through a worker (a call for each takes minutes on sf0.1) and match as a plain loop does."""
    import random

    rnd = random.Random(3)
    nan = float("nan")
    schema = "doc string, page int, ord long, value double, unit string, kind string"

    def rows(top):
        of = [("a", 1, 500), (None, 2, 3), ("a", None, 4), *(("b", p, rnd.randint(0, top)) for p in range(300))]
        return [(d, p, o, rnd.choice([1.0, 1.005, 2.0, None, nan, 0.0]), rnd.choice(["m", None]), rnd.choice(["x", "y"])) for d, p, n in of for o in range(n)]

    gold, got = rows(4), rows(3)
    want = []
    for page in {r[:2] for r in gold}:
        g, r = ([x for x in side if x[:2] == page] for side in (gold, got))
        used, done = set(), set()
        none = lambda v: v is None or v != v
        near = lambda v, w: none(v) and none(w) or not none(v) and not none(w) and abs(v - w) <= 0.01 * max(abs(v), abs(w))
        for same in (True, False):
            for x in g:
                fits = [y for y in r if y[2] not in used and y[4] == x[4] and near(x[3], y[3]) and (not same or x[5] == y[5])] if x[2] not in done else []
                if fits:
                    used.add(fits[0][2]), done.add(x[2])
                    want.append((*page, x[2], fits[0][2], x[5], fits[0][5]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    found = scoring.greedy_match(spark.createDataFrame(gold, schema), spark.createDataFrame(got, schema), ["doc", "page"], told=("kind",))
    assert sorted(map(str, want)) == sorted(str(tuple(x)) for x in found.collect()) and len(want) > 400
    assert "CoGroups" not in found._jdf.queryExecution().toString()


def test_search_counts_substrings(spark):
    x = spark.createDataFrame([(1, "Water works", ["sewage"], "X", 1970), (2, "Roads", ["water"], "Water Co", None), (3, "Roads", ["x"], "Water Co", 1960)], "ord int, title string, subject array<string>, publisher string, year int")
    assert [(r.ord, r.score) for r in search.search(x, "water").collect()] == [(1, 3.0), (2, 2.5)]


MINUTES = """Council met 1992 March 4. It was moved by Alderman Smith, and seconded by Ms. Jones, that the
report be adopted. YEAS: Mayor Morrow, Aldermen Cole, D`Amico -3. NAYS: Evans -1. CARRIED. Re: Rent of the hall Recorded vote
YEAS: Cole, Evans, Smith. -2. NAYS: -0. Moved by Mr. Cole and seconded by Mr. Evans that it be tabled"""


def test_motions(spark):
    found = decisions.read_page(MINUTES)
    assert [(m["mover"], m["seconder"], m["outcome"], m["date"]) for m in found] == [("Smith", "Jones", "carried", "1992-Mar-04"), ("", "", "carried", "1992-Mar-04"), ("", "", "tabled", "1992-Mar-04"), ("Cole", "Evans", "tabled", "1992-Mar-04")]
    assert [len(m["rolls"]) for m in found] == [0, 2, 2, 0]
    rolls = [(r["cast"], r["people"], r["stated"]) for m in found for r in m["rolls"]]
    assert ("yea", ["Morrow", "Cole", "D'Amico"], 3) in rolls and ("nay", ["Evans"], 1) in rolls and ("yea", ["Cole", "Evans", "Smith"], 2) in rolls and ("nay", [], 0) in rolls
    assert any(m["text"] == "Rent of the hall" for m in found)
    assert decisions.read_page(None) == [] and not decisions.plausible("motion") and decisions.clean_name(" O‘Brien ,") == "O'Brien"


def test_people_and_dissent(spark):
    pages = spark.createDataFrame([("v1", 1, MINUTES, "1990"), ("v1", 2, None, "1990"), ("v2", 1, "Moved by Smith and seconded by Jones that x be done. LOST.", "1980")], "identifier string, page int, text string, year string")
    found = decisions.motions(pages, ["identifier", "page"], year="year").cache()
    assert [r.date for r in found.where("identifier = 'v2'").collect()] == ["1980"]
    people = {r.person: r for r in decisions.people(found, "identifier").collect()}
    assert (people["smith"].moved, people["smith"].yea, people["smith"].documents, people["smith"].first_seen, people["smith"].last_seen) == (2, 1, ["v1", "v2"], "1980", "1992-Mar-04")
    assert [(r.person, r.nays) for r in decisions.dissenters(decisions.people(found, "identifier")).collect()] == [("evans", 1)]
    assert [r.against for r in decisions.divided(found, ["identifier", "page"]).collect()] == [["Evans"]]
    check = decisions.roll_checks(found).first()
    assert (check.recorded_votes, check.rolls_that_do_not_reconcile, check.rolls_with_no_tally) == (2, 1, 0)
    assert {(r.mover, r.seconder, r.n) for r in decisions.partnerships(found, "mover", "seconder").collect()} == {("smith", "jones", 2), ("cole", "evans", 1)}
    titles = {(r.person, r.title) for r in decisions.titles(pages).collect()}
    assert {("smith", "Alderman"), ("morrow", "Mayor"), ("cole", "Alderman"), ("jones", "Ms.")} <= titles


def test_limiter_counts_admitted_hits_only():
    assert stateful.admit([0, 1, 2, 3, 11], [], 2, 10)[0] == [True, True, False, False, True]


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"place": "", "records": [{"kind": "observation", "value": 1.5, "provenance": {"page": 2}}]}))
    (tmp_path / "b.json").write_text(json.dumps({"other": 1}))
    r = readers.extraction_records(spark, str(tmp_path / "*.json")).collect()
    assert len(r) == 1 and r[0].value == 1.5 and r[0].provenance.page == 2
    xml = '<OBJECT width="10" height="20"><PARAGRAPH><LINE><WORD x-confidence="90">Hello</WORD> <WORD x-confidence="80">there</WORD></LINE><LINE><WORD>you</WORD></LINE></PARAGRAPH></OBJECT><OBJECT></OBJECT>'
    p = readers.scanned_pages(spark.createDataFrame([("i", xml)], "identifier string, xml string")).collect()
    assert [(x.page, x.width, x.ocr_confidence, x.text) for x in p] == [(1, 10, 0.85, "Hello there\nyou")]


def test_sql_functions(spark):
    assert "ll_slug" in sql.register(spark)
    r = spark.sql("SELECT ll_slug('A b!') AS a, ll_words_to_number('twenty two') AS b, ll_values_match(100, 100.5) AS c").first()
    assert (r.a, r.b, r.c) == ("a-b", 22.0, True)
    r = spark.sql("SELECT ll_evidence_tokens('Flow > 3. 12') AS a, ll_value_in_quote(3.12, 'was 3.12') AS b, ll_place_key('Élora Twp') AS c, ll_term_key('B.O.D') AS d, ll_value_in_quote(CAST(NULL AS DOUBLE), NULL) AS e").first()
    assert (r.a, r.b, r.c, r.e) == (["word:flow", "semantic:>", "number:3.12"], "ok", "elora township", "unchecked")


def test_stream_limiter(spark, tmp_path):
    src = tmp_path / "in"
    spark.sql("SELECT 1L AS user, timestamp'2024-01-01 00:00:00' AS ts, 1L AS event UNION ALL SELECT 1L, timestamp'2024-01-01 00:00:01', 2L UNION ALL SELECT 1L, timestamp'2024-01-01 00:00:02', 3L").write.parquet(str(src))
    s = stateful.rate_limit_stream(spark.readStream.schema("user long, ts timestamp, event long").parquet(str(src)), "user", "ts", "event", 2, 60.0)
    q = s.writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.event, r.admitted) for r in spark.table("limited").collect()} == {(1, True), (2, True), (3, False)}
