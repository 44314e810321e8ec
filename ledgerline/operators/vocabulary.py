"""Vocabulary of terms: building from readings, surveys, validation, retrieval for a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.parameters import with_parameter
from ledgerline.operators.records import normalised
from ledgerline.operators.sampling import coverage

# Units that contradict a measure; the least readings of a judged stratum; the coverage at which a survey stops.
BULK = r"(?i)\b(lbs?|pounds?|tons?|tonnes?|kg|kilograms?|grams?|gal|gallons?|litres?|liters?|m3|cubic\s*(feet|foot|metres?|meters?)|acre[- ]?feet)\b"
PER_TIME = r"(?i)(/\s*(d|day|hr|hour|min|sec|yr|year)|per\s+(day|hour|minute|year|capita)|mgd|cfs)\b"
STEM_DROPS = r"\b(average|total|annual|daily|monthly|mean|maximum|minimum|concentration|content|level|value|reading|rate)\b"
HINTS = (
    ("water", r"mg/|ug/|ppm|ppb|coliform|turbid|chlorin"),
    ("education", r"pupil|school|exam|grade|enrol|teacher|curricul"),
    ("agriculture", r"acre|crop|yield|livestock|farm|fertil"),
    ("forestry", r"timber|forest|silvicult|stand|cord"),
    ("population", r"census|dwelling|household|populat"),
    ("energy", r"gas|petroleum|coal|kwh|megawatt|barrel"),
    ("mining", r"ore|tonnage|mine|smelt"),
    ("air", r"emission|stack|ambient|dustfall|smoke"),
)
CLEAN_SCAN, MATERIAL_DRIFT = 60.0, 0.01
LEAST_READINGS, TARGET = 40, 0.975


def contradicted(measure, unit) -> Column:
    """Whether the unit of a reading speaks against the measure its name was given."""
    m, u = (F.col(x) if isinstance(x, str) else x for x in (measure, unit))
    bare = ~F.regexp_replace(u, "(mg|ug)/", "").contains("/")
    return F.coalesce(F.when(m == "concentration", u.rlike(BULK) & bare).when(m == "total", u.rlike(PER_TIME)), F.lit(False))


def attested(name, quote) -> Column:
    """Whether a normalised name stands in a normalised quote as whole words."""
    n, q = (F.col(x) if isinstance(x, str) else x for x in (name, quote))
    return (n != "") & F.contains(F.concat(F.lit(" "), q, F.lit(" ")), F.concat(F.lit(" "), n, F.lit(" ")))


def build(readings: DataFrame, units: int = 6) -> DataFrame:
    """Terms of readings (parameter, unit, source_text, substance, measure) whose name the quote attests.

    term, n, spelling (most frequent, ties by text), aliases, units, and substance and
    measure where all readings agree and no unit contradicts them.
    """
    x = readings.withColumn("term", normalised(F.col("parameter"))).where(attested("term", normalised(F.col("source_text"))))
    x = x.withColumn("bad", contradicted("measure", "unit"))
    spelled = x.groupBy("term", "parameter").agg(F.count("*").alias("k")).groupBy("term").agg(F.min(F.struct((-F.col("k")).alias("k"), "parameter")).alias("m"), F.sort_array(F.collect_set("parameter")).alias("aliases"))
    unit = x.where("unit is not null and unit <> ''").groupBy("term", "unit").agg(F.count("*").alias("k"))
    unit = unit.withColumn("at", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("k"), "unit"))).where(F.col("at") <= units)
    unit = unit.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("at", "unit"))).alias("u")).select("term", F.col("u.unit").alias("units"))
    same = lambda c: F.when((F.count_distinct(c) == 1) & (F.count(c) == F.count("*")) & ~F.bool_or("bad"), F.max(c))
    agreed = x.groupBy("term").agg(F.count("*").alias("n"), same("substance").alias("substance"), same("measure").alias("measure"))
    return agreed.join(spelled.select("term", F.col("m.parameter").alias("spelling"), "aliases"), "term").join(unit, "term", "left").orderBy(F.desc("n"), "term")


def collisions(terms: DataFrame) -> DataFrame:
    """Keys that two terms (canonical, aliases) both claim; a term's own repeats count once."""
    x = terms.select("canonical", F.explode(F.array_distinct(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name"))
    return x.select("canonical", normalised(F.col("name")).alias("key")).distinct().groupBy("key").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("canonical")).alias("terms")).where("n > 1")


def for_prompt(page_text: DataFrame, terms: DataFrame, limit: int = 240) -> DataFrame:
    """The terms (canonical, aliases, domain, readings_covered) most relevant to each page (page_id, text): those whose whole name it holds, those it shares a long word with, then the most used.

    Pages and terms meet by words; a page that shares words with fewer than ``limit``
    terms is filled up from the most used ones.
    """
    terms = terms if "aliases" in terms.columns else terms.withColumn("aliases", F.array().cast("array<string>"))
    long_words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) > 3))
    keys = F.array_distinct(F.transform(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>"))), F.lower))
    t = terms.select("canonical", "domain", "readings_covered", F.explode(keys).alias("name")).withColumn("key", normalised(F.col("name"))).where("key <> ''")
    p = page_text.select("page_id", normalised(F.col("text")).alias("h"))
    by_word = p.select("page_id", F.explode(F.array_distinct(F.split("h", " "))).alias("w"))
    first = t.withColumn("w", F.get(F.split("key", " "), F.lit(0))).select("canonical", "key", "w")
    phrase = by_word.join(first, "w").join(p, "page_id").where(F.contains(F.concat(F.lit(" "), "h", F.lit(" ")), F.concat(F.lit(" "), "key", F.lit(" "))))
    word = by_word.where(F.length("w") > 3).join(t.select("canonical", F.explode(long_words(F.col("key"))).alias("w")).distinct(), "w")
    hits = phrase.select("page_id", "canonical", F.lit(1).alias("phrase"), F.lit(0).alias("word")).unionByName(word.select("page_id", "canonical", F.lit(0).alias("phrase"), F.lit(1).alias("word")))
    hits = hits.groupBy("page_id", "canonical").agg(F.max("phrase").alias("phrase"), F.max("word").alias("word")).join(terms.select("canonical", "domain", F.col("readings_covered").cast("long").alias("covered")), "canonical")
    order = Window.partitionBy("page_id").orderBy(F.desc("phrase"), F.desc("word"), F.desc("covered"), "canonical")
    hits = hits.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit).drop("k")
    have = page_text.select("page_id").join(hits.groupBy("page_id").agg(F.count("*").alias("n"), F.collect_set("canonical").alias("has")), "page_id", "left")
    short = have.withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < limit)
    # the most used terms are at most ``limit``, one list for all pages that are short of some
    top = terms.orderBy(F.desc("readings_covered"), "canonical").limit(limit).agg(F.sort_array(F.collect_list(F.struct((-F.col("readings_covered").cast("long")).alias("c"), "canonical", "domain"))).alias("top"))
    filled = short.join(F.broadcast(top)).withColumn("more", F.slice(F.filter("top", lambda x: ~F.array_contains(F.coalesce("has", F.array().cast("array<string>")), x["canonical"])), 1, limit))
    more = filled.select("page_id", F.explode(F.slice("more", F.lit(1), F.greatest(F.lit(0), F.lit(limit) - F.col("n")))).alias("x"))
    more = more.select(F.col("x.canonical").alias("canonical"), "page_id", F.lit(0).alias("phrase"), F.lit(0).alias("word"), F.col("x.domain").alias("domain"), (-F.col("x.c")).alias("covered"))
    return hits.unionByName(more)


def matched(readings: DataFrame, terms: DataFrame, name: str = "parameter") -> DataFrame:
    """readings with ``term`` (the canonical name that a spelling or alias belongs to, the first in order of coverage) and ``known``."""
    keys = terms.select("canonical", "readings_covered", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    keys = keys.withColumn("_key", normalised(F.col("n"))).where("_key <> ''").groupBy("_key").agg(F.min_by("canonical", F.struct(-F.col("readings_covered"), "canonical")).alias("term"))
    distinct = readings.select(F.col(name).alias("_name")).distinct().withColumn("_key", normalised(F.col("_name"))).join(keys, "_key", "left").drop("_key")
    return readings.join(distinct, F.col(name) == F.col("_name"), "left").drop("_name").withColumn("known", F.col("term").isNotNull())


def validation_errors(terms: DataFrame) -> DataFrame:
    """(canonical, problem) of terms (canonical, substance, measure, aliases, typical_units, readings_covered, reviewed): what makes a vocabulary unsafe to match with."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    empty = lambda c: F.exists(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))) == "")
    again = lambda c: F.size(F.array_distinct(F.col(c))) < F.size(F.col(c))
    say = lambda when, text: F.when(F.coalesce(when, F.lit(False)), F.lit(text))
    rules = F.array_compact(F.array(
        say(blank("canonical"), "empty canonical name"),
        say(~blank("canonical") & (normalised(F.col("canonical")) == ""), "canonical name has no letters or digits"),
        say(blank("substance") != blank("measure"), "substance and measure must both be set or both be empty"),
        say(F.col("readings_covered").isNull(), "readings_covered must be an integer"),
        say(F.col("readings_covered") < 0, "readings_covered must be non-negative"),
        say(F.col("reviewed").isNull(), "reviewed must be true or false"),
        say(empty("aliases"), "aliases cannot be empty"),
        say(again("aliases"), "aliases must be unique"),
        say(empty("typical_units"), "typical_units cannot be empty"),
        say(again("typical_units"), "typical_units must be unique"),
    ))
    own = terms.select("canonical", F.explode(rules).alias("problem"))
    shared = collisions(terms).select(F.lit("").alias("canonical"), F.concat(F.lit("matching key '"), "key", F.lit("' is claimed by: "), F.array_join("terms", ", ")).alias("problem"))
    return own.unionByName(shared)


def unreviewed(terms: DataFrame) -> DataFrame:
    return terms.where("not reviewed").orderBy(F.desc("readings_covered"), "canonical")


def stem(name) -> Column:
    """Grouping form of a name: lower case, words that tell the kind of number dropped."""
    t = F.regexp_replace(F.lower(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))), "[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, STEM_DROPS, " "), r"\s+", " "))


def domain_hint(text) -> Column:
    """The domain whose words a text holds first in the order of HINTS, else null."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(*(F.when(t.rlike("(?i)" + p), F.lit(d)) for d, p in HINTS))


def observed(readings: DataFrame) -> DataFrame:
    """readings (parameter, unit, source_text, stratum, family, ocr_confidence) with stem, measure, term, verbatim, bad, resolved: one row a usable reading."""
    x = with_parameter(readings.withColumn("stem", stem("parameter"))).where("stem <> ''")
    x = x.withColumn("measure", F.coalesce("resolved.measure", F.lit(""))).withColumn("term", F.concat_ws("|", "stem", F.nullif(F.col("measure"), F.lit(""))))
    verbatim = F.contains(F.lower(F.coalesce("source_text", F.lit(""))), F.lower(F.trim("parameter")))
    return x.withColumn("verbatim", verbatim).withColumn("bad", F.col("resolved").isNotNull() & contradicted("measure", "unit")).withColumn("resolved", F.col("resolved").isNotNull())


def survey(readings: DataFrame) -> DataFrame:
    """One row a term of observed(): counts, and whether it is the archive's own language, settled, or only seen on poor scans."""
    clean = F.col("ocr_confidence").isNull() | (F.col("ocr_confidence") >= CLEAN_SCAN)
    x = readings.groupBy("term").agg(
        F.count("*").alias("n"), F.count_if("verbatim").alias("verbatim"), F.count_distinct("family").alias("families"), F.sort_array(F.collect_set("stratum")).alias("strata"),
        F.bool_or("resolved").alias("resolved"), F.count_if("bad").alias("contested"), F.count_if(clean).alias("clean"), F.count_if(~clean).alias("damaged"),
    )
    return x.withColumn("archive_language", F.col("verbatim") > 0).withColumn("settled", F.col("resolved") & (F.col("contested") == 0)).withColumn("suspect", (F.col("damaged") > 0) & (F.col("clean") == 0))


def unsettled(terms: DataFrame) -> DataFrame:
    """Terms of the archive's language that do not resolve, or resolve to what their unit denies."""
    return terms.where("archive_language and not settled")


def survey_report(terms: DataFrame) -> DataFrame:
    """(part, readings, observed, f1, f2, coverage, chao1, low, high): of the archive's language, the model's, without suspect scans, and the unsettled terms."""
    parts = (("archive", F.col("archive_language")), ("model", ~F.col("archive_language")), ("archive without suspects", F.col("archive_language") & ~F.col("suspect")), ("unsettled", F.col("archive_language") & ~F.col("settled")))
    x = terms.select("n", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in parts)))).alias("part"))
    return coverage(x, ["part"])


def survey_controls(terms: DataFrame) -> DataFrame:
    """One row: the share of readings that the model named, and how far poor scans shift the coverage."""
    r = survey_report(terms).groupBy().agg(*(F.max(F.when(F.col("part") == p, F.col(c))).alias(f"{n}_{c}") for p, n in (("archive", "a"), ("model", "m"), ("archive without suspects", "s")) for c in ("readings", "coverage")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    drift = F.abs(F.coalesce("s_coverage", F.lit(0.0)) - F.coalesce("a_coverage", F.lit(0.0)))
    share = zero("m_readings") / F.greatest(F.lit(1), zero("a_readings") + zero("m_readings"))
    return r.select(F.round(share, 4).alias("model_named_share"), F.round(drift, 4).alias("drift"), (drift > MATERIAL_DRIFT).alias("material"))


def weakest(by_stratum: DataFrame, limit: int = 10) -> DataFrame:
    """The strata of strata_coverage() to read next: unjudged ones, then the least covered."""
    missing = F.greatest(F.lit(0.0), F.round(F.col("chao1") - F.col("observed"), 1))
    return by_stratum.withColumn("still_missing", missing).orderBy("judged", F.asc_nulls_first("coverage"), "stratum").limit(limit)


def strata_coverage(terms: DataFrame, planned: DataFrame) -> DataFrame:
    """Coverage of each planned stratum from a survey; a term counts in full in each stratum it was seen in; unjudged below the least readings."""
    x = coverage(terms.select(F.explode("strata").alias("stratum"), "n"), ["stratum"])
    return planned.select("stratum").join(x, "stratum", "left").withColumn("judged", F.coalesce(F.col("readings") >= LEAST_READINGS, F.lit(False)))


def done(by_stratum: DataFrame) -> DataFrame:
    """One row: whether every planned stratum is judged and the least coverage reaches the target."""
    return by_stratum.agg(F.coalesce(F.bool_and("judged") & (F.min("coverage") >= TARGET), F.lit(False)).alias("done"), F.min("coverage").alias("weakest"), F.sort_array(F.collect_set(F.when(~F.col("judged"), F.col("stratum")))).alias("unjudged"))


def discovery(readings: DataFrame, round_: str = "round", term: str = "term") -> DataFrame:
    """(round, new_terms, total): terms first seen in each round."""
    x = readings.groupBy(term).agg(F.min(round_).alias(round_)).groupBy(round_).agg(F.count("*").alias("new_terms"))
    return x.withColumn("total", F.sum("new_terms").over(Window.orderBy(round_)))
