"""Named questions to a corpus: analysis of a place, lookups, disputes, reviews, rescoring, watershed pages, publishing."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import evidence_tokens
from ledgerline.operators import decisions, narrate, scoring, series, town, vocabulary
from ledgerline.plans.views import reading_series

# The series that a place is analysed by (key, stream, what it tells), the horizon of silences, the parts of a diagnosis.
TARGETS = (
    ("bod|removal", None, "how much oxygen-demanding waste the plant removed"),
    ("suspended solids|removal", None, "how much solid matter the plant removed"),
    ("bod|concentration", "effluent", "concentration the town discharged"),
    ("bod|concentration", "influent", "concentration arriving at the plant"),
    ("suspended solids|concentration", "effluent", "solids concentration discharged"),
    ("flow|rate", None, "sewage passing through, per day"),
    ("flow|total", None, "sewage passing through, per year"),
)
HORIZON = 1996
KINDS = ("observation", "standard", "conclusion", "design")


def held(records: DataFrame, query: str) -> DataFrame:
    """Records whose place has the query in its name."""
    return records.where(F.contains(F.lower(F.coalesce("place", F.lit(""))), F.lit(query.strip().lower())))


def years_of(records: DataFrame) -> DataFrame:
    """(place, years): the years of each place's records."""
    year = F.substring("period", 1, 4).try_cast("int")
    return records.where(F.trim("place") != "").groupBy(F.lower(F.trim("place")).alias("place")).agg(F.sort_array(F.collect_set(year)).alias("years"))


def analyse(records: DataFrame) -> DataFrame:
    """One row a place and target with two years at least: points, the trend and change point in words and numbers."""
    pts = reading_series(records)
    wanted = F.lit(False)
    gloss = F.lit(None).cast("string")
    for key, stream, said in TARGETS:
        hit = (F.col("key") == key) & (F.col("stream") == stream if stream else F.lit(True))
        wanted, gloss = wanted | hit, F.when(hit & gloss.isNull(), said).otherwise(gloss)
    own = ["place", "key", "stream", "facility", "series_unit"]
    x = pts.where(wanted).withColumn("t", F.col("t").cast("double"))
    many = x.groupBy(*own).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("t", "v"))).alias("points")).where("n >= 2").drop("n")
    moved = series.trend(x, own)
    moved = moved.select(*own, "ok", narrate.trend_sentence().alias("trend"))
    shift = series.pettitt(x, own).select(*own, F.col("at").alias("changed_at"), "shift", F.col("p_value").alias("change_p"), "detected")
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in own]
    out = many.join(moved, same(many, moved), "left").select(*(many[c] for c in many.columns), "ok", "trend")
    out = out.join(shift, same(out, shift), "left").select(*(out[c] for c in out.columns), "changed_at", "shift", "change_p", "detected")
    return out.withColumn("told", gloss)


def coverage_of_places(records: DataFrame) -> DataFrame:
    """One row a place: records by kind, and its years in words."""
    x = records.where(F.trim("place") != "")
    kinds = x.groupBy("place").agg(F.count("*").alias("n"), *(F.count_if(F.col("kind") == k).alias(k) for k in KINDS))
    years = x.select("place", F.substring("period", 1, 4).try_cast("int").alias("year")).where("year is not null")
    said = series.silence(years, ["place"], horizon=HORIZON).select("place", narrate.silence_sentence("place").alias("coverage"))
    return kinds.join(said, "place", "left")


def municipalities(silences: DataFrame, located: DataFrame, records: DataFrame) -> DataFrame:
    """Places of a silence report (place, first_year, last_year, silent_since) with their point (place, lat, lon), whether records of them were extracted, and the years these report."""
    years = years_of(records).withColumnRenamed("place", "_p")
    points = located.select(F.lower("place").alias("_q"), "lat", "lon").dropDuplicates(["_q"])
    x = silences.join(points, F.lower("place") == F.col("_q"), "left").join(years, F.lower("place") == F.col("_p"), "left")
    return x.withColumn("extracted", F.col("_p").isNotNull()).withColumn("reported", F.coalesce("years", F.array().cast("array<int>"))).drop("_p", "_q", "years")


def watershed_page(rivers: DataFrame) -> DataFrame:
    """One row a river of network.watershed(): its links in order of drainage area, the places from source to mouth, and totals."""
    link = F.struct("up_area", "upstream", "downstream", "down_area", "confidence")
    x = rivers.groupBy("river").agg(F.sort_array(F.collect_list(link)).alias("links"))
    places = F.array_distinct(F.flatten(F.transform("links", lambda k: F.array(k["upstream"], k["downstream"]))))
    return x.withColumn("places", places).withColumn("n_links", F.size("links")).withColumn("n_likely", F.size(F.filter("links", lambda k: k["confidence"] == "likely"))).orderBy(F.desc("n_links"), "river")


def disputed(standings: DataFrame, limit: int = 20) -> DataFrame:
    """Contested slots of standings (slot, value, verified, identifier, page, quote), those with most readings first: the values that survive with where each stands, and whether one sentence is read in two ways."""
    ok = standings.where("verified")
    quotes = F.count_distinct(F.array_join(evidence_tokens("quote"), chr(31)))
    x = ok.groupBy("slot").agg(F.sort_array(F.collect_set(F.struct("value", "identifier", "page", "quote"))).alias("readings"), F.count_distinct("value").alias("n_values"), F.count_distinct(F.struct("identifier", "page")).alias("pages"), quotes.alias("quotes"), F.count("*").alias("n"))
    listed = (F.col("pages") == 1) & (F.col("quotes") == F.col("n"))
    x = x.where((F.col("n_values") > 1) & ~listed).withColumn("same_sentence", F.col("quotes") == 1)
    return x.select("slot", "n_values", "same_sentence", "readings").orderBy(F.desc("n_values"), "slot").limit(limit)


def ledger_report(slots: DataFrame) -> DataFrame:
    """One row: how many slots of ledger.slots() are in each state."""
    return slots.agg(F.count("*").alias("slots"), *(F.count_if(F.col("state") == s).alias(s) for s in ("settled", "contested", "undistinguished", "unsupported")))


def who_decided(pages: DataFrame, year: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Motions and people of volumes (identifier, page, text)."""
    found = decisions.motions(pages, ["identifier", "page"], year=year)
    return decisions.decided(found), decisions.people(found, "identifier")


def review_file(proposals: DataFrame) -> DataFrame:
    """Proposals of sampling.harvest() (stem, n, variants, units) as rows for a person to decide: domain hinted, decision and canonical empty."""
    hint = vocabulary.domain_hint(F.concat_ws(" ", "stem", F.concat_ws(" ", "units")))
    none = F.lit(None).cast("string")
    return proposals.select(F.col("stem").alias("proposed_term"), F.col("n").alias("occurrences"), F.col("variants").alias("written_as"), F.col("units").alias("units_seen"), hint.alias("suggested_domain"), none.alias("decision"), none.alias("canonical")).orderBy(F.desc("occurrences"), "proposed_term")


def applied_review(reviewed: DataFrame) -> DataFrame:
    """(domain, spelling, canonical) of the proposals that a person marked ``keep``: silence is no consent."""
    x = reviewed.where("decision = 'keep'").withColumn("canonical", F.coalesce(F.nullif(F.trim("canonical"), F.lit("")), "proposed_term"))
    names = F.array_distinct(F.concat(F.transform(F.coalesce("written_as", F.array().cast("array<string>")), F.lower), F.array("proposed_term")))
    return x.select(F.coalesce("suggested_domain", F.lit("unsorted")).alias("domain"), F.explode(names).alias("spelling"), "canonical").distinct()


def readings_of(records: DataFrame, items: DataFrame) -> DataFrame:
    """Records as readings of a vocabulary survey: parameter, unit, source_text, stratum, family, ocr_confidence."""
    from ledgerline.operators.batches import vocabulary_family

    i = items.select("identifier", F.col("stratum"), vocabulary_family("title").alias("family"))
    return records.join(i, "identifier", "left").select("parameter", "unit", "source_text", F.coalesce("stratum", F.lit("unsorted")).alias("stratum"), F.coalesce("family", F.lit("")).alias("family"), "ocr_confidence")


def identity_of_groups(readings: DataFrame) -> DataFrame:
    """(term, n, measure): the measure that all attested readings of a term agree on and no unit denies, else null; readings: vocabulary.observed()."""
    own = vocabulary.normalised(F.col("parameter"))
    x = readings.withColumn("group", own).where(vocabulary.attested("group", vocabulary.normalised(F.coalesce("source_text", F.lit("")))))
    sure = (F.count_distinct("measure") == 1) & F.bool_and("resolved") & ~F.bool_or("bad")
    return x.groupBy("group").agg(F.count("*").alias("n"), F.when(sure, F.max("measure")).alias("measure")).withColumnRenamed("group", "term")


def scores(gold: DataFrame, got: DataFrame) -> DataFrame:
    """One row a gold page (identifier, page): gold, got, matched, kind_ok, stream_ok, stream_n of greedy matches; gold and got: identifier, page, ord, value, unit, kind, stream."""
    keys = ["identifier", "page"]
    m = scoring.greedy_match(gold, got, keys, told=("kind", "stream"))
    asked = F.col("gold_stream").isNotNull() & (F.col("gold_stream") != "unknown")
    found = m.groupBy(*keys).agg(F.count("*").alias("matched"), F.count_if(F.col("gold_kind") == F.col("got_kind")).alias("kind_ok"), F.count_if(asked & (F.col("gold_stream") == F.col("got_stream"))).alias("stream_ok"), F.count_if(asked).alias("stream_n"))
    n = gold.groupBy(*keys).agg(F.count("*").alias("gold")).join(got.groupBy(*keys).agg(F.count("*").alias("got")), keys, "left").join(found, keys, "left")
    return n.select(*keys, "gold", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("got", "matched", "kind_ok", "stream_ok", "stream_n")))


def kind_confusions(gold: DataFrame, got: DataFrame) -> DataFrame:
    """(gold_kind, got_kind, n) of matches whose kinds differ."""
    m = scoring.greedy_match(gold, got, ["identifier", "page"], told=("kind",))
    return m.where("gold_kind <> got_kind").groupBy("gold_kind", "got_kind").agg(F.count("*").alias("n"))


def rescored(gold: DataFrame, got: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Totals over the gold documents that a saved run holds records of, and those it holds none of, which are not scored."""
    touched = got.select("identifier").distinct()
    return scoring.totals(scores(gold.join(touched, "identifier", "left_semi"), got)), gold.select("identifier").distinct().join(touched, "identifier", "left_anti")


def reader_bench(gold: DataFrame, made: DataFrame) -> DataFrame:
    """(what, precision, recall, f1, kind_accuracy, stream_accuracy): of all that a reader made, and of what passed its checks (made: passed)."""
    every = scoring.totals(scores(gold, made)).withColumn("what", F.lit("model output"))
    return every.unionByName(scoring.totals(scores(gold, made.where("passed"))).withColumn("what", F.lit("as published")))


def rejected_as_records(rejects: DataFrame) -> DataFrame:
    """Rejected candidates (identifier, page, row_label, column_label, source_text, parameter, value, unit, kind, confidence) in the form of records: a missing citation is made from the headings."""
    cell = F.concat(F.lit("table cell ["), F.coalesce("row_label", F.lit("")), F.lit(" / "), F.coalesce("column_label", F.lit("")), F.lit("]"))
    given = F.coalesce(F.nullif(F.trim("source_text"), F.lit("")), cell)
    return rejects.select(F.coalesce("kind", F.lit("observation")).alias("kind"), F.coalesce("parameter", F.lit("")).alias("parameter"), "value", "unit", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.struct("identifier", "page", given.alias("source_text"), F.lit("vision").alias("path")).alias("provenance"))


def provider_problems(providers: DataFrame) -> DataFrame:
    """(name, problem) of declarations (name, tier, endpoint, licence, auth_mode, env_var): what keeps a source from being used or passed on."""
    tier, auth = F.col("tier"), F.coalesce("auth_mode", F.lit("none"))
    rules = F.array_compact(F.array(
        F.when((tier == 0) & (auth != "none"), F.concat(F.lit("declared tier 0 but requires "), auth, F.lit(" auth; tier 0 means keyless"))),
        F.when((tier > 0) & (F.coalesce("env_var", F.lit("")) == ""), F.concat(F.lit("tier "), tier.cast("string"), F.lit(" but no env_var to read a key from"))),
        F.when(~F.coalesce(F.col("endpoint").startswith("https://"), F.lit(False)), F.lit("endpoint is not https")),
        F.when(F.coalesce("licence", F.lit("")) == "", F.lit("no licence recorded — required before redistributing data")),
    ))
    return providers.select("name", F.explode(rules).alias("problem"))


def provider_status(providers: DataFrame, keys: list[str]) -> DataFrame:
    """(name, usable, needs): keyless sources are usable, others where one of the given variables holds their key."""
    keyless = (F.col("tier") == 0) & (F.coalesce("auth_mode", F.lit("none")) == "none")
    ready = keyless | F.coalesce(F.col("env_var").isin(*keys), F.lit(False)) if keys else keyless
    return providers.select("name", ready.alias("usable"), F.when(~ready, F.concat(F.lit("needs a key in "), F.coalesce(F.nullif(F.col("env_var"), F.lit("")), F.lit("(not declared)")))).alias("needs"))


def publish_generation(df: DataFrame, path: str) -> str:
    """Write a whole table as a new generation and make it the current one: readers see the old rows or the new ones, never a mixture.  The generation's name."""
    from ledgerline.sources.writers import _path, transaction

    spark, name = df.sparkSession, f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"
    df.write.mode("errorifexists").parquet(f"{path}/generations/{name}")
    with transaction(spark, f"{path}/current"):
        fs, pointer = _path(spark, f"{path}/current")
        stream = fs.create(pointer, True)
        stream.write(bytearray(name.encode()))
        stream.close()
    return name


def current_generation(spark, path: str) -> DataFrame:
    """The rows of the generation that was published last."""
    name = spark.read.text(f"{path}/current", wholetext=True).first()[0].strip()
    return spark.read.parquet(f"{path}/generations/{name}")


def town_answers(records: DataFrame, place: str) -> DataFrame:
    """A town's summary, told by its name or, if that is unknown, by the plants that carry it."""
    mine = records.where(town.same_town("place", [place])).withColumn("place", F.lit(place))
    return town.summary(mine)
