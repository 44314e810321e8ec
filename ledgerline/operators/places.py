"""Place names of an era: dimension joins in order of authority, with time intervals.

A name is looked up, in this order, among what is no place, localities within a
merged city, historical entries, aliases, titles cut off after a plant's name,
townships and populated places of the gazetteer.  Distinct (name, year) are resolved
once; every dimension is keyed by a folded form of the name.  Ambiguous names get a
low confidence and no coordinates; nothing is matched fuzzily.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rank of generic terms, confidences, patterns of locality and cut-off titles, parts of a plant.
TERM_RANK = {
    "city": 0, "town": 1, "village municipality": 2, "village": 2, "urban community": 3, "suburban community": 4, "compact rural community": 5,
    "community": 6, "settlement": 7, "dispersed rural community": 8, "railway point": 20,
}
OTHER_TERM = 10
WITHIN, AFTER, BEFORE, AMBIGUOUS, CUT_OFF = 0.99, 0.9, 0.65, 0.35, 0.96
LOCALITY = r"(?i)^\s*cambridge\s*\(\s*(galt|preston|hespeler)\s*\)\s*$"
TAIL = r"(?i)\s*(?::|,)?\s*(water\s+(?:treatment\s+plant|supply\s+system))\s+and\s*$"
PART = r"(?i)^(?:unit|pump|tank|cell|bay|well|filter|blower|digester|clarifier|motor|engine|line|stage|train|module|no\.?|number)(?:\s*(?:no\.?|number|#))?\s*\d*[a-z]?$"

_SPAN = "valid_from int, valid_to int"
_ENTRY = f"canonical string, kind string, lat double, lon double, superseded_by string, event_note string, coordinate_note string, {_SPAN}"
_KINDS = f"kind_periods array<struct<kind: string, valid_from: int, valid_to: int>>"
#: Schemas of the dimensions; an entry's resolution periods override its fields for their years.
HISTORY = f"names array<string>, {_ENTRY}, {_KINDS}, resolution_periods array<struct<{', '.join(x.strip().replace(' ', ': ', 1) for x in _ENTRY.split(','))}, kind_periods: array<struct<kind: string, valid_from: int, valid_to: int>>>>"
ALIASES = "names array<string>, canonical string, candidate_id string, history_name string, kind string, lat double, lon double, confidence double, note string"
PLACE = T.StructType().add("canonical", "string").add("lat", "double").add("lon", "double").add("kind", "string").add("province", "string").add("confidence", "double").add("as_of_year", "integer").add("superseded_by", "string").add("note", "string")


def folded_name(text: str | None) -> str:
    """Comparison form: accents, case and punctuation folded, ``&`` and ``twp`` spelled out; no word is dropped."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))
    words = re.findall("[a-z0-9]+", plain.casefold().replace("&", " and "))
    return " ".join("township" if w == "twp" else w for w in words)


def _folded(names: pd.Series) -> pd.Series:
    return names.map(folded_name)


def place_key(name) -> Column:
    """Column form of folded_name()."""
    return F.pandas_udf(_folded, "string")(F.col(name) if isinstance(name, str) else name)


def _holds(period: Column, year: Column) -> Column:
    """Whether a validity interval, open where null, holds a year."""
    return (period["valid_from"].isNull() | (year >= period["valid_from"])) & (period["valid_to"].isNull() | (year <= period["valid_to"]))


def _place(canonical, lat, lon, kind, confidence, year, superseded_by, note) -> Column:
    parts = dict(canonical=canonical, lat=lat, lon=lon, kind=kind, province=F.lit("ON"), confidence=confidence, as_of_year=year, superseded_by=superseded_by, note=note)
    return F.struct(*(parts[f.name].cast(f.dataType).alias(f.name) for f in PLACE.fields))


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once and named, so that it is not repeated in the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _with(place: Column, **changed: Column) -> Column:
    """A place (a name, not an expression) with some fields changed."""
    return F.struct(*((changed[f.name] if f.name in changed else place[f.name]).cast(f.dataType).alias(f.name) for f in PLACE.fields))


def _noted(place: Column, note: Column, factor: float = 1.0) -> Column:
    """A place (a name) with a further remark, its confidence scaled and rounded."""
    confidence = place["confidence"] if factor == 1.0 else F.round(place["confidence"] * factor, 4)
    return _with(place, note=F.concat_ws(" ", place["note"], note), confidence=confidence)


def historical_place(entry: Column, year: Column) -> Column:
    """What a historical entry (a struct of HISTORY) says of a year.

    The first resolution period that holds the year overrides the entry.  Within its
    interval an entry is sure; after it less so, and still less before.
    """
    held = lambda periods: F.get(F.filter(periods, lambda p: year.isNotNull() & _holds(p, year)), F.lit(0))

    def overridden(period: Column) -> Column:
        fields = [F.coalesce(period[n], entry[n]).alias(n) for n in ("canonical", "kind", "lat", "lon", "superseded_by", "event_note", "coordinate_note", "kind_periods")]
        return F.struct(*fields, *(F.when(period.isNotNull(), period[n]).otherwise(entry[n]).alias(n) for n in ("valid_from", "valid_to")))

    def timed(own: Column) -> Column:
        kind = F.coalesce(held(own["kind_periods"])["kind"], own["kind"])
        return F.struct(own.alias("own"), kind.alias("kind"), F.coalesce(year < own["valid_from"], F.lit(False)).alias("early"), F.coalesce(year > own["valid_to"], F.lit(False)).alias("late"))

    def told(x: Column) -> Column:
        own, kind, y = x["own"], x["kind"], year.cast("string")
        name, event = own["canonical"], own["event_note"]
        say = lambda a, b, c: F.concat(name, F.lit(a), b, F.lit(" in "), y, F.lit(c), event, F.lit("."))
        note = (
            F.when(year.isNull(), F.concat(F.upper(F.substring(event, 1, 1)), F.substring(event, 2, 1 << 30), F.lit(".")))
            .when(x["early"], say(" did not exist as a ", kind, "; it was "))
            .when(x["late"], say(" no longer existed as a separate ", F.when(kind == "unknown", "municipality").otherwise(kind), "; it was "))
            .when(own["superseded_by"].isNotNull(), say(" was a separate ", kind, "; it was later "))
            .otherwise(F.concat(name, F.lit(" was valid in "), y, F.lit("; it was "), event, F.lit(".")))
        )
        confidence = F.when(x["early"], BEFORE).when(x["late"], AFTER).otherwise(WITHIN)
        return _place(name, own["lat"], own["lon"], kind, confidence, year, own["superseded_by"], F.concat_ws(" ", note, own["coordinate_note"]))

    return _let(held(entry["resolution_periods"]), lambda period: _let(overridden(period), lambda own: _let(timed(own), told)))


def kind_of(candidate: Column) -> Column:
    """Kind of a gazetteer row by its generic term and concise code."""
    term = F.lower(candidate["generic_term"])
    return F.when(term.contains("township"), "township").when(candidate["concise_code"] == "CITY", "city").when(candidate["concise_code"] == "TOWN", "town").when((candidate["concise_code"] == "VILG") | term.contains("village"), "village").otherwise("unknown")


def gazetteer_choices(gazetteer: DataFrame) -> DataFrame:
    """(k, town, townships): for each folded name its populated places by rank, and its townships, as counts and the row that would be taken."""
    g = gazetteer.withColumn("k", place_key("name")).withColumn("c", F.struct("id", "name", "generic_term", "concise_code", "lat", "lon", "decision_date"))
    ranks = F.create_map(*(F.lit(x) for kv in TERM_RANK.items() for x in kv))
    rank = F.coalesce(F.try_element_at(ranks, F.lower("generic_term")), F.lit(OTHER_TERM))
    populated = F.col("generic_category") == "Populated Place"
    township = (F.col("generic_category") == "Administrative Area") & F.lower("generic_term").contains("township")
    g = g.where(populated | township).withColumn("what", F.when(populated, "town").otherwise("township")).withColumn("rank", F.when(populated, rank).when(F.col("concise_code") == "MUN2", 0).otherwise(1))
    ranked = g.groupBy("k", "what", "rank").agg(F.count("*").alias("n"), F.min(F.struct("id", "c")).alias("m"))
    best = ranked.groupBy("k", "what").agg(F.min(F.struct("rank", "n", F.col("m.c").alias("c"))).alias("b"), F.sum("n").alias("all"))
    best = best.select("k", "what", F.struct("b.rank", "b.n", "b.c", "all").alias("choice"))
    return best.groupBy("k").agg(F.max(F.when(F.col("what") == "town", F.col("choice"))).alias("town"), F.max(F.when(F.col("what") == "township", F.col("choice"))).alias("townships"))


def _ambiguous(name: Column, year: Column, note: Column) -> Column:
    none = F.lit(None)
    return _place(F.trim(F.regexp_replace(name, r"\s+", " ")), none, none, F.lit("unknown"), F.lit(AMBIGUOUS), year, none, note)


def populated_place(name: Column, choice: Column, year: Column) -> Column:
    """The populated place of the best term; a tie is ambiguous, namesakes and a later naming decision cost confidence."""
    c, none = choice["c"], F.lit(None)
    decided = F.substring(c["decision_date"], 1, 4).try_cast("int")
    later = F.coalesce(decided > year, F.lit(False))
    sure = F.when(c["concise_code"].isin("CITY", "TOWN"), 0.99).otherwise(0.96)
    confidence = F.least(sure, F.when(choice["all"] > 1, 0.9).otherwise(1.0), F.when(later, 0.85).otherwise(1.0))
    among = F.when(choice["all"] > 1, F.concat(F.lit("Selected the CGNDB "), F.lower(c["generic_term"]), F.lit(" among "), choice["all"].cast("string"), F.lit(" Ontario populated features with this name.")))
    caution = F.when(later, F.concat(F.lit("The CGNDB naming decision is dated "), decided.cast("string"), F.lit("; the reference point is usable, but that date does not establish the place's municipal class in "), year.cast("string"), F.lit(".")))
    note = F.when(among.isNotNull() | caution.isNotNull(), F.concat_ws(" ", among, caution))
    tie = _ambiguous(name, year, F.concat(F.lit("CGNDB contains "), choice["n"].cast("string"), F.lit(" equally plausible populated places with this name.")))
    return F.when(choice["n"] == 1, _place(c["name"], c["lat"], c["lon"], kind_of(c), confidence, year, none, note)).when(choice["n"] > 1, tie)


def township_place(name: Column, base: Column, choice: Column, year: Column) -> Column:
    """The township of that name: a municipal one before others; none or several are ambiguous."""
    c, none = choice["c"], F.lit(None)
    one = _place(F.concat(c["name"], F.lit(" Township")), c["lat"], c["lon"], F.lit("township"), F.when(choice["rank"] == 0, 0.99).otherwise(0.96), year, none, none)
    missing = _ambiguous(name, year, F.concat(F.lit("The title says township, but CGNDB has no matching Ontario township for '"), base, F.lit("'.")))
    several = _ambiguous(name, year, F.concat(F.lit("CGNDB contains "), choice["n"].cast("string"), F.lit(" township candidates with this name.")))
    return F.when(choice["n"].isNull(), missing).when(choice["n"] == 1, one).otherwise(several)


def alias_place(alias: Column, candidate: Column, entry: Column, year: Column) -> Column:
    """What an alias says of a year: its history with the candidate's point, else the candidate, else its own point."""
    none = F.lit(None)
    moved = candidate.isNotNull() & ~(candidate["lat"].eqNullSafe(entry["lat"]) & candidate["lon"].eqNullSafe(entry["lon"]))

    def of_past(past: Column) -> Column:
        point = lambda axis: F.coalesce(candidate[axis], F.when(candidate.isNull(), alias[axis]), past[axis])
        sure = F.least(past["confidence"], F.coalesce(alias["confidence"], F.lit(1.0)))
        return _with(past, canonical=alias["canonical"], lat=point("lat"), lon=point("lon"), confidence=sure, note=F.concat_ws(" ", past["note"], alias["note"]))

    plain = entry.withField("coordinate_note", F.when(~moved, entry["coordinate_note"]))
    past = _let(plain, lambda e: _let(historical_place(e, year), of_past))
    own = _place(alias["canonical"], alias["lat"], alias["lon"], F.coalesce(alias["kind"], F.lit("unknown")), F.coalesce(alias["confidence"], F.lit(0.4)), year, none, alias["note"])
    of_candidate = _place(alias["canonical"], candidate["lat"], candidate["lon"], F.coalesce(alias["kind"], kind_of(candidate)), F.coalesce(alias["confidence"], F.lit(0.9)), year, none, alias["note"])
    return F.when(entry.isNotNull(), past).when(candidate.isNotNull(), of_candidate).otherwise(own)


def dimension_problems(history: DataFrame, aliases: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(problem, name): names that two entries claim, points with one coordinate, and candidates that the gazetteer lacks."""
    twice = lambda d, what: d.select(F.explode("names").alias("n"), F.monotonically_increasing_id().alias("e")).select(place_key("n").alias("name"), "e").distinct().groupBy("name").count().where("count > 1").select(F.lit(what).alias("problem"), "name")
    half = aliases.where(F.col("lat").isNull() != F.col("lon").isNull()).select(F.lit("only one coordinate").alias("problem"), F.col("canonical").alias("name"))
    gone = aliases.where("candidate_id is not null").join(gazetteer.select(F.col("id").alias("candidate_id")), "candidate_id", "left_anti").select(F.lit("missing candidate").alias("problem"), F.col("canonical").alias("name"))
    return twice(history, "duplicate historical place").unionByName(twice(aliases, "duplicate alias")).unionByName(half).unionByName(gone)


def _levels(asked: DataFrame) -> DataFrame:
    """(name, year, level, base, tail, last): a name, then what is left of it without a cut-off plant's name, as long as it ends in one."""
    now = asked.select("name", "year", F.lit(0).alias("level"), F.col("name").alias("base"), F.lit(None).cast("string").alias("tail"))
    out = now
    while True:
        cut = now.where(F.col("base").rlike(TAIL))
        tail = F.lower(F.regexp_replace(F.regexp_extract("base", TAIL, 1), r"\s+", " "))
        now = cut.select("name", "year", (F.col("level") + 1).alias("level"), F.btrim(F.regexp_replace("base", TAIL, ""), F.lit(" ,:-")).alias("base"), tail.alias("tail"))
        if now.isEmpty():
            return out.withColumn("last", ~F.col("base").rlike(TAIL))
        out = out.unionByName(now)


def resolve_places(rows: DataFrame, name: str, year: str, history: DataFrame, aliases: DataFrame, gazetteer: DataFrame, non_places: list[str] = ()) -> DataFrame:
    """rows with ``place`` (a struct of PLACE): null for what is no place or an unknown one.

    history, aliases: see HISTORY and ALIASES; gazetteer: readers.gazetteer().  A blank
    or null name is no place.
    """
    asked = rows.select(F.col(name).alias("name"), F.col(year).cast("int").alias("year")).where(F.trim("name") != "").distinct()
    x = _levels(asked).withColumn("k", place_key("base"))
    x = x.withColumn("locality", F.lower(F.regexp_extract("base", LOCALITY, 1))).withColumn("hk", F.when(F.col("locality") != "", F.col("locality")).otherwise(F.col("k")))
    fields = [f.name for f in T.StructType.fromDDL(HISTORY).fields if f.name != "names"]
    entries = history.select(F.explode("names").alias("n"), F.struct(*fields).alias("entry")).select(place_key("n").alias("ek"), "entry").dropDuplicates(["ek"])
    named = aliases.select(F.explode("names").alias("n"), F.struct("canonical", "candidate_id", "history_name", "kind", "lat", "lon", "confidence", "note").alias("alias"))
    named = named.select(place_key("n").alias("k"), "alias", place_key(F.coalesce("alias.history_name", "alias.canonical")).alias("ahk")).dropDuplicates(["k"])
    rowed = gazetteer.select(F.col("id").alias("cid"), F.struct("id", "name", "generic_term", "concise_code", "lat", "lon", "decision_date").alias("candidate")).dropDuplicates(["cid"])
    x = x.join(entries.select(F.col("ek").alias("hk"), "entry"), "hk", "left").join(named, "k", "left")
    x = x.join(entries.select(F.col("ek").alias("ahk"), F.col("entry").alias("past")), "ahk", "left").join(rowed, F.col("alias.candidate_id") == F.col("cid"), "left")
    of = F.when(F.col("k").endswith(" township"), F.regexp_replace("k", " township$", "")).when(F.col("k").startswith("township of "), F.regexp_replace("k", "^township of ", ""))
    x = x.withColumn("base_k", F.nullif(of, F.lit("")))
    choices = gazetteer_choices(gazetteer)
    x = x.join(choices.select("k", "town"), "k", "left").join(choices.select(F.col("k").alias("base_k"), "townships"), "base_k", "left")
    y, is_locality = F.col("year"), F.col("locality") != ""
    of_locality = _let(historical_place(F.col("entry"), y), lambda p: _noted(p, F.concat(F.lit("The title preserves the "), F.initcap("locality"), F.lit(" locality within Cambridge."))))
    found = (
        F.when(is_locality, F.when(F.col("entry").isNotNull(), of_locality))
        .when(F.col("entry").isNotNull(), historical_place(F.col("entry"), y))
        .when(F.col("alias").isNotNull(), alias_place(F.col("alias"), F.col("candidate"), F.col("past"), y))
        .when(~F.col("last"), F.lit(None))
        .when(F.col("base_k").isNotNull(), township_place(F.col("base"), F.col("base_k"), F.col("townships"), y))
        .when(F.col("town").isNotNull(), populated_place(F.col("base"), F.col("town"), y))
    )
    nothing = F.col("k").isin(*(folded_name(n) for n in non_places)) if non_places else F.lit(False)
    told = nothing | is_locality | F.col("entry").isNotNull() | F.col("alias").isNotNull() | F.col("last")
    x = x.select("name", "year", "level", "tail", F.when(~nothing, found).alias("found"), told.alias("told"))
    # the first level that is told decides; each plant's name that was cut off leaves a remark, from the inside out
    cut = F.array_sort(F.collect_list(F.when(F.col("tail").isNotNull(), F.struct("level", "tail"))))
    x = x.groupBy("name", "year").agg(F.min(F.when(F.col("told"), F.struct("level", "found"))).alias("m"), cut.alias("cut"))
    cuts = F.reverse(F.filter(F.col("cut"), lambda c: c["level"] <= F.col("m.level")))
    remark = lambda c: F.concat(F.lit("Recovered from a truncated "), c["tail"], F.lit(" document title."))
    place = F.aggregate(cuts, F.col("m.found"), lambda p, c: F.when(p.isNotNull(), _noted(p, remark(c), CUT_OFF)))
    x = x.select(F.col("name").alias("_n"), F.col("year").alias("_y"), place.alias("place"))
    return rows.join(x, (F.col(name) == F.col("_n")) & F.col(year).cast("int").eqNullSafe(F.col("_y")), "left").drop("_n", "_y")


def squeezed(x) -> Column:
    """Text with single blanks; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.col(x) if isinstance(x, str) else x, r"\s+", " ")), F.lit(""))


def scope_records(records: DataFrame, history: DataFrame, aliases: DataFrame, gazetteer: DataFrame, non_places: list[str] = (), file_place: str = "file_place") -> DataFrame:
    """records with place and facility as their file's place has them, and ``reported_place`` where that changed.

    What a record names stays its place only if it is another populated place than the
    file's.  A name that is no place, the same municipality, or a locality that an alias
    of the file's place points to becomes the facility, if none was given.
    """
    names = records.columns
    x = records.withColumn("_raw", squeezed("place")).withColumn("_scope", squeezed(file_place)).withColumn("_specific", squeezed("facility")).withColumn("_year", F.substring("period", 1, 4).try_cast("int"))
    pairs = x.where("_raw is not null and _scope is not null and lower(_raw) <> lower(_scope)").select("_raw", "_scope", "_year").distinct()
    asked = pairs.select(F.explode(F.array("_raw", "_scope")).alias("n"), F.col("_year").alias("y")).distinct()
    known = resolve_places(asked, "n", "y", history, aliases, gazetteer, non_places).select("n", "y", F.lower("place.canonical").alias("is_"))
    pairs = pairs.join(known.select(F.col("n").alias("_raw"), F.col("y").alias("_year2"), F.col("is_").alias("_raw_is")), "_raw", "left").where("_year <=> _year2").drop("_year2")
    pairs = pairs.join(known.select(F.col("n").alias("_scope"), F.col("y").alias("_year2"), F.col("is_").alias("_scope_is")), "_scope", "left").where("_year <=> _year2").drop("_year2")
    curated = aliases.where("candidate_id is not null").select(F.explode("names").alias("n"), "candidate_id").join(gazetteer.select(F.col("id").alias("candidate_id"), F.col("name").alias("inner")), "candidate_id")
    curated = curated.select(place_key("n").alias("_sk"), place_key("inner").alias("_rk")).distinct().withColumn("_curated", F.lit(True))
    pairs = pairs.withColumn("_sk", place_key("_scope")).withColumn("_rk", place_key("_raw")).join(curated, ["_sk", "_rk"], "left")
    inside = F.col("_raw_is").isNull() | (F.col("_raw_is") == F.col("_scope_is")) | F.col("_curated")
    pairs = pairs.select("_raw", "_scope", F.col("_year").alias("_y"), F.coalesce(inside, F.lit(False)).alias("_inside"))
    x = x.join(pairs.withColumnRenamed("_raw", "_r").withColumnRenamed("_scope", "_s"), (F.col("_raw") == F.col("_r")) & (F.col("_scope") == F.col("_s")) & F.col("_year").eqNullSafe(F.col("_y")), "left")
    same = F.col("_raw").isNull() | (F.lower("_raw") == F.lower("_scope"))
    place = F.when(F.col("_scope").isNull(), F.col("_raw")).when(same | F.col("_inside"), F.col("_scope")).otherwise(F.col("_raw"))
    facility = F.when(F.col("_scope").isNotNull() & ~same & F.col("_inside"), F.coalesce("_specific", "_raw")).otherwise(F.col("_specific"))
    x = x.withColumn("_place", place).withColumn("_facility", facility)
    given = {"place": F.col("_place"), "facility": F.col("_facility")}
    return x.select(*(given[c].alias(c) if c in given else F.col(c) for c in names), F.when(F.col("_raw").isNotNull() & ~F.col("_place").eqNullSafe(F.col("_raw")), F.col("_raw")).alias("reported_place"))


def facility_key(facility, place=None) -> Column:
    """Grouping form of a plant's name: the town's own name at one end and words that only decorate are dropped."""
    flat = lambda x: F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")), r"\s+", " ")))
    t = flat(facility)
    if place is not None:
        town = flat(place)
        size = F.length(town) + 1
        ahead, behind = t.startswith(F.concat(town, F.lit(" "))), t.endswith(F.concat(F.lit(" "), town))
        cut = lambda t, a, b: F.when(town == "", t).when(a, F.substr(t, size + 1)).when(b, F.substr(t, F.lit(1), F.length(t) - size)).otherwise(t)
        t = cut(t, ahead, behind)
        # a name may carry the town at both ends, or twice
        t = cut(t, t.startswith(F.concat(town, F.lit(" "))), t.endswith(F.concat(F.lit(" "), town)))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\b(the|of|corporation|city|town|township|village)\b", " "), r"\s+", " "))


def attach_subunits(records: DataFrame, document: str = "identifier", facility: str = "facility", ord_: str = "ord") -> DataFrame:
    """records with ``parent_facility``: for a part of a plant, the plant its document names most (ties: the first named)."""
    named = squeezed(facility)
    part = F.coalesce(named.rlike(PART), F.lit(False))
    of = F.coalesce(F.col(document).cast("string"), F.lit(""))
    k = records.select(of.alias("_document"), named.alias("_named"), part.alias("_part"), F.col(ord_).alias("_ord")).where("_named is not null and not _part")
    k = k.groupBy("_document", "_named").agg(F.count("*").alias("_n"), F.min("_ord").alias("_o"))
    top = k.groupBy("_document").agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_o").alias("o"), F.col("_named").alias("f"))).alias("m")).select("_document", F.col("m.f").alias("_parent"))
    return records.withColumn("_document", of).join(top, "_document", "left").withColumn("parent_facility", F.when(part, F.col("_parent"))).drop("_parent", "_document")
