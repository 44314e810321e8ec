"""A town's page: everything read about it, partitioned, each reading listed once.

Readings fall into groups (label, stream, facility).  A group with several years
becomes lines of a panel, one with a single year is listed by itself, and one whose
units or periods cannot be compared is listed as it is.  Everything is rows: rows()
is the page's list of readings, the other functions aggregate it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.parameters import resolve, with_parameter
from ledgerline.functions.units import parse_unit
from ledgerline.operators.places import facility_key, squeezed

# Labels that come first, suffixes that make a town's name a plant's, abbreviations, headings of kinds, names of what has none.
PREFERRED = ("BOD removal", "suspended solids removal", "BOD", "suspended solids", "daily flow", "total flow", "population")
SUFFIX = (
    r"(?i)\s+(water pollution control plant|sewage treatment plant|pollution control plant|water treatment plant|water supply system|treatment plant|filtration plant|sewage works|water works"
    r"|wpcp|stp|wtp|plant|works)(?![a-z]).*$"
)
PLAIN = {
    "bod": "biochemical oxygen demand", "ss": "suspended solids", "ml.ss.": "mixed liquor suspended solids", "mlss": "mixed liquor suspended solids", "thms": "trihalomethanes", "total thms": "trihalomethanes",
    "doc": "dissolved organic carbon", "toc": "total organic carbon", "cod": "chemical oxygen demand", "do": "dissolved oxygen", "tds": "total dissolved solids", "vss": "volatile suspended solids", "wpcp": "water pollution control plant",
}
KIND_TITLES = {"design": "What it was built for", "standard": "What it was allowed to discharge", "conclusion": "What the report concluded"}
NO_FACILITY, NO_SUBJECT = "unclassified", "not attributed to any works"


def same_town(place, wanted: list[str]) -> Column:
    """Whether a place is one of the wanted towns, by itself or without the name of a plant."""
    p = F.lower(F.col(place) if isinstance(place, str) else place)
    bare = F.btrim(F.regexp_replace(p, SUFFIX, ""), F.lit(" ,-"))
    names = [w.lower() for w in wanted if w]
    return F.coalesce(p.isin(*names) | ((bare != "") & bare.isin(*names)), F.lit(False)) if names else F.lit(False)


def town_name(place) -> Column:
    """A place without the name of a plant behind it."""
    p = F.col(place) if isinstance(place, str) else place
    return F.nullif(F.btrim(F.regexp_replace(F.trim(p), SUFFIX, ""), F.lit(" ,-")), F.lit(""))


def plain_label(label) -> Column:
    """The label with its abbreviation spelled out, if it is one or begins with one."""
    c = F.col(label) if isinstance(label, str) else label
    words = F.create_map(*(F.lit(x) for kv in PLAIN.items() for x in kv))
    key = F.lower(F.trim(c))
    full = F.coalesce(F.try_element_at(words, key), F.try_element_at(words, F.get(F.split(key, r"\s+"), F.lit(0))))
    return F.when(full.isNotNull(), F.concat(c, F.lit(" ("), full, F.lit(")"))).otherwise(c)


def _first_most(rows: DataFrame, keys: list[str], value: str, ord_: str) -> DataFrame:
    """keys and the most frequent value, ties to the one that came first."""
    k = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(ord_).alias("_o"))
    return k.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_o").alias("o"), F.col(value).alias("v"))).alias("m")).select(*keys, F.col("m.v").alias(value))


def summary(records: DataFrame) -> DataFrame:
    """One row a place: its main facility (ties: the first named), the others, and of the main one years, span, counts, labels and sources."""
    x = with_parameter(records.withColumn("_f", F.coalesce("facility", F.lit(NO_FACILITY)))).withColumn("_p", F.lower(F.trim("place"))).where("_p <> ''")
    main = _first_most(x, ["_p"], "_f", "ord").withColumnRenamed("_f", "_main")
    x = x.join(main, "_p")
    year, own, seen = F.substring("period", 1, 4).try_cast("int"), F.col("_f") == F.col("_main"), F.col("kind") == "observation"
    label = F.coalesce("resolved.label", "parameter")
    head = x.groupBy("_p").agg(
        F.min_by("place", "ord").alias("place"),
        F.max("_main").alias("facility"),
        F.sort_array(F.collect_set(F.when(~own, F.col("_f")))).alias("other_facilities"),
        F.sort_array(F.collect_set(F.when(own, year))).alias("years"),
        F.count_if(own).alias("n_records"),
        F.count_if(own & seen).alias("n_measurements"),
        F.sort_array(F.collect_set(F.when(own, F.col("identifier")))).alias("sources"),
    )
    counts = x.where(own & seen).groupBy("_p", label.alias("label")).agg(F.count("*").alias("n"))
    measured = counts.groupBy("_p").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "label"))).alias("m"))
    measured = measured.select("_p", F.transform("m", lambda e: F.struct(e["label"].alias("label"), (-e["k"]).alias("n"))).alias("measured"))
    span = F.when(F.size("years") > 0, F.array(F.array_min("years"), F.array_max("years")))
    return head.join(measured, "_p", "left").withColumn("span", span).drop("_p")


def rows(records: DataFrame) -> DataFrame:
    """Every observation of each town once, in the group that ranks first among those that hold it.

    Columns of records, then: label (as most of its group words it), facility_group, outcome
    (series, single or bare), unit and value of the group's series (series_unit, v),
    charted, and rank, the order of groups on the page.
    """
    own = ["town", "resolved_label", "stream", "facility_group"]
    in_town = F.lower(F.coalesce(town_name("place"), F.trim("place")))
    main = records.where("kind = 'observation'").select(in_town.alias("town"), F.coalesce(F.nullif(F.lower("facility"), F.lit("")), F.lit(NO_FACILITY)).alias("_main"), "ord")
    main = _first_most(main.where("town <> ''"), ["town"], "_main", "ord")
    x = with_parameter(records.where("kind = 'observation'"), context="source_text")
    x = x.withColumn("town", in_town).where("town <> ''")
    x = x.withColumn("resolved_label", F.coalesce("resolved.label", F.trim("parameter"))).where("resolved_label <> ''")
    x = x.withColumn("facility_group", F.coalesce(F.nullif(facility_key("facility", "town"), F.lit("")), F.lit(NO_FACILITY)))
    x = x.withColumn("stream", F.coalesce("stream", F.lit(""))).withColumn("_said", F.lower(F.trim("parameter"))).withColumn("year", F.substring("period", 1, 4).try_cast("int"))
    x = x.withColumn("_flow", F.when(F.col("resolved.substance") == "flow", F.when(F.col("resolved.measure") == "total", "total").otherwise("rate"))).drop("resolved")
    parsed = x.select(F.col("unit").alias("_u"), F.col("year").alias("_y"), F.col("_flow").alias("_f")).distinct().withColumn("_q", parse_unit("_u", "_y", "_f"))
    x = x.join(parsed, F.col("unit").eqNullSafe(F.col("_u")) & F.col("year").eqNullSafe(F.col("_y")) & F.col("_flow").eqNullSafe(F.col("_f")), "left").drop("_u", "_y", "_f")
    # from here on one exchange by the group serves all that is asked of it
    group, base = Window.partitionBy(*own), F.col("_q.base")
    able = F.col("year").isNotNull() & F.col("value").isNotNull() & base.isNotNull()
    by_unit, by_wording = Window.partitionBy(*own, "_base"), Window.partitionBy(*own, "_said")
    x = x.withColumn("_base", F.when(able, base))
    x = x.withColumn("_vote", F.when(F.col("_base").isNotNull(), F.struct((-F.count("*").over(by_unit)).alias("n"), F.min("ord").over(by_unit).alias("o"), F.col("_base").alias("v"))))
    x = x.withColumn("_spoken", F.when(F.col("_said") != "", F.struct((-F.count("*").over(by_wording)).alias("n"), F.min("ord").over(by_wording).alias("o"), F.col("_said").alias("v"))))
    x = x.withColumn("series_unit", F.min("_vote").over(group)["v"]).withColumn("label", F.coalesce(F.min("_spoken").over(group)["v"], F.col("resolved_label")))
    x = x.withColumn("_size", F.count("*").over(group)).withColumn("_first", F.min("ord").over(group))
    # one best reading a year, of those in the unit that most of the group have
    fits = F.coalesce(F.col("_base") == F.col("series_unit"), F.lit(False))
    x = x.withColumn("_v", F.when(fits, F.col("value") * F.col("_q.multiplier")))
    order = Window.partitionBy(*own, "year").orderBy(F.when(fits, 0).otherwise(1), F.desc("confidence"), "_v", "ord")
    x = x.withColumn("charted", fits & (F.row_number().over(order) == 1)).withColumn("v", F.when(F.col("charted"), F.col("_v")))
    x = x.withColumn("_points", F.sum(F.col("charted").cast("int")).over(group))
    x = x.withColumn("outcome", F.when(F.col("_points") > 1, "series").when(F.col("_points") == 1, "single").otherwise("bare"))
    x = x.join(main, "town", "left")
    preferred = F.coalesce(*(F.when(F.lower("resolved_label").contains(p.lower()), i) for i, p in enumerate(PREFERRED)), F.lit(len(PREFERRED)))
    at_main = F.when((F.col("facility_group") == F.col("_main")) | (F.col("facility_group") == facility_key("_main", "town")), 0).otherwise(1)
    x = x.withColumn("rank", F.struct(at_main.alias("main"), preferred.alias("preferred"), (-F.col("_size")).alias("n"), F.col("_first").alias("first")))
    same = Window.partitionBy("town", "label", "identifier", "page", "value", "unit", "period", "qualifier").orderBy("rank", "period", "parameter", "ord")
    x = x.withColumn("_k", F.row_number().over(same)).where("_k = 1")
    return x.select(*records.columns, *(c for c in ("town", "label", "resolved_label", "facility_group", "outcome", "series_unit", "v", "year", "charted", "rank") if c not in records.columns))


def panels(listed: DataFrame) -> DataFrame:
    """One row a panel (town, facility_group, label, series_unit) of rows(): lines by stream with their points, counts, span and range, and the substance it is shelved under."""
    key = ["town", "facility_group", "label", "series_unit"]
    x = listed.where("outcome = 'series'").withColumn("stream", F.when(F.col("stream") == "unknown", "").otherwise(F.coalesce("stream", F.lit(""))))
    seen = F.col("charted")
    line = x.groupBy(*key, "stream").agg(
        F.sort_array(F.collect_list(F.when(seen, F.struct(F.col("year"), "v")))).alias("points"), F.count("*").alias("n"), F.min(F.when(seen, F.col("year"))).alias("first_year"), F.max(F.when(seen, F.col("year"))).alias("last_year"), F.min(F.when(seen, F.col("v"))).alias("low"), F.max(F.when(seen, F.col("v"))).alias("high"),
    )
    out = line.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("stream", "points"))).alias("lines"), F.count("*").alias("n_lines"), F.sum("n").alias("n"), F.min("first_year").alias("first_year"), F.max("last_year").alias("last_year"), F.min("low").alias("low"), F.max("high").alias("high"))
    out = out.withColumn("plain", plain_label("label"))
    return out.withColumn("substance", F.coalesce(resolve("label", "series_unit")["substance"], F.lit("")))


def shelves(found: DataFrame, group: list[str], within: list[str]) -> DataFrame:
    """found with ``shelf``: the substance where a run of it begins, in the order of ``within``; what has none comes last."""
    order = Window.partitionBy(*group).orderBy((F.col("substance") == "").cast("int"), "substance", *within)
    return found.withColumn("_at", F.row_number().over(order)).withColumn("shelf", F.when(F.lag("substance").over(order).eqNullSafe(F.col("substance")), "").otherwise(F.col("substance"))).drop("_at")


def systems(found: DataFrame) -> DataFrame:
    """One row a facility of a town of panels(): title, panels by shelf, count, span; the largest first."""
    shelved = shelves(found.withColumn("_n", -F.col("n")), ["town", "facility_group"], ["_n", "label"])
    many = F.count("*").over(Window.partitionBy("town", "facility_group", "substance"))
    shelved = shelved.withColumn("shelf", F.when((F.col("substance") != "") & (many == 1), "").otherwise(F.col("shelf")))
    one = F.struct((F.col("substance") == "").alias("none"), "substance", "_n", "label", "shelf", "series_unit", "n")
    x = shelved.groupBy("town", "facility_group").agg(F.sort_array(F.collect_list(one)).alias("panels"), F.sum("n").alias("n"), F.min("first_year").alias("first_year"), F.max("last_year").alias("last_year"))
    title = F.concat(F.upper(F.substring("facility_group", 1, 1)), F.substring("facility_group", 2, 1 << 30))
    return x.withColumn("title", title).orderBy("town", F.desc("n"), "facility_group")


def singles(listed: DataFrame) -> DataFrame:
    """One row a group that is not charted as a line: town, label, stream, facility_group, outcome, n, substance, shelf."""
    x = listed.where("outcome <> 'series'").groupBy("town", "label", "stream", "facility_group", "outcome").agg(F.count("*").alias("n"))
    x = x.withColumn("substance", F.coalesce(resolve("label")["substance"], F.lit("")))
    return shelves(x, ["town"], ["label", "stream", "facility_group"])


def subjects(records: DataFrame) -> DataFrame:
    """What a document described, by place and kind: one row a specification of a unit of a works.

    place, kind, title, works, unit_name, parameter, value, unit, first_period, restatements
    (the other places that say the same).  The works is the parent facility, else the
    facility, else NO_SUBJECT; observations take no part.
    """
    x = with_parameter(records.where("kind <> 'observation'"), context="source_text")
    label, subject, parent = F.coalesce("resolved.label", "parameter", F.lit("")), squeezed("facility"), squeezed("parent_facility")
    subject_parent = F.when(subject.isNotNull(), parent)
    x = x.select(
        "place", "kind", F.coalesce(subject_parent, subject, F.lit(NO_SUBJECT)).alias("works"), F.when(subject_parent.isNotNull(), subject).otherwise("").alias("unit_name"), label.alias("parameter"), "value", F.coalesce("unit", F.lit("")).alias("unit"),
        F.struct("ord", F.coalesce("period", F.lit("")).alias("period"), "identifier", "page", F.col("source_text").alias("quote")).alias("said"),
    )
    x = x.groupBy("place", "kind", "works", "unit_name", "parameter", "value", "unit").agg(F.sort_array(F.collect_list("said")).alias("said"))
    titles = F.create_map(*(F.lit(v) for kv in KIND_TITLES.items() for v in kv))
    first = F.get("said", F.lit(0))
    return x.select("place", "kind", F.coalesce(F.try_element_at(titles, F.col("kind")), F.col("kind")).alias("title"), "works", "unit_name", "parameter", "value", "unit", first["period"].alias("first_period"), F.slice("said", 2, F.greatest(F.lit(1), F.size("said"))).alias("restatements"))


def attribution(found: DataFrame) -> DataFrame:
    """One row a place of subjects(): specifications with and without a works."""
    none = F.col("works") == NO_SUBJECT
    return found.groupBy("place").agg(F.count_if(~none).alias("with_subject"), F.count_if(none).alias("without_subject"))


def neighbours(links: DataFrame) -> DataFrame:
    """(place, upstream, downstream, rivers) of river links (river, upstream, downstream), both ways."""
    both = links.select(F.lower("upstream").alias("place"), F.lit(None).cast("string").alias("up"), F.col("downstream").alias("down"), "river").unionByName(links.select(F.lower("downstream").alias("place"), F.col("upstream").alias("up"), F.lit(None).cast("string").alias("down"), "river"))
    return both.where("place <> ''").groupBy("place").agg(F.sort_array(F.collect_set("up")).alias("upstream"), F.sort_array(F.collect_set("down")).alias("downstream"), F.sort_array(F.collect_set("river")).alias("rivers"))


def page(records: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """One row a town: counts of what is charted and listed, sources, systems, and its neighbours on rivers."""
    listed = rows(records)
    counts = listed.groupBy("town").agg(F.count_if(F.col("outcome") == "series").alias("n_charted"), F.count("*").alias("n_measurements"), F.sort_array(F.collect_set(F.nullif(F.col("identifier"), F.lit("")))).alias("sources"))
    alone = singles(listed).groupBy("town").agg(F.count("*").alias("n_listed"))
    shown = systems(panels(listed)).groupBy("town").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "facility_group", "title", "panels", "first_year", "last_year"))).alias("systems"))
    out = counts.join(alone, "town", "left").join(shown, "town", "left").withColumn("n_listed", F.coalesce("n_listed", F.lit(0)))
    return out if links is None else out.join(neighbours(links).withColumnRenamed("place", "town"), "town", "left")
