"""Composite views: a town's page, its story, what went quiet, the frontier of answerable questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.parameters import with_parameter
from ledgerline.operators import series
from ledgerline.operators.places import facility_key
from ledgerline.operators.town import town_name

# The parameters of a story, the years a trend needs, the year before which a record counts as gone quiet.
STORY = ("bod|removal", "suspended solids|removal", "flow|rate")
TREND_YEARS, QUIET, HORIZON = 6, 1975, 1996


def reading_series(records: DataFrame, kind: str = "observation") -> DataFrame:
    """Points of every series of records (place, facility, parameter, unit, value, stream, kind, period, confidence, ord).

    place, key, stream, facility, t, v, c, series_unit: resolved, brought to the base
    unit most readings of the series have, one best reading a year.
    """
    x = with_parameter(records.where(F.col("kind") == kind)).withColumn("key", F.coalesce("resolved.key", F.lower("parameter"))).withColumn("facility", facility_key("facility", "place")).withColumn("year", F.substring("period", 1, 4).try_cast("int"))
    flow = F.when(F.col("resolved.substance") == "flow", F.when(F.col("resolved.measure") == "total", "total").otherwise("rate"))
    x = x.withColumn("flow", flow).where("year is not null and value is not null")
    own = ["place", "key", "stream", "facility"]
    x = series.majority_unit(x, own, era="year", flow="flow").where("rejected is null").withColumn("v", F.col("value") * F.col("parsed_unit.multiplier"))
    return series.best_reading(x, [*own, "series_unit"], "year", "v", "confidence")


def story(points: DataFrame) -> DataFrame:
    """Chapters of each place: first and last reading of the story's parameters, with the trend or why there is none."""
    own = ["place", "key", "stream", "facility", "series_unit"]
    x = points.where(F.col("key").isin(*STORY))
    ends = x.groupBy(*own).agg(F.min_by("v", "t").alias("first_value"), F.min("t").alias("first_year"), F.max_by("v", "t").alias("last_value"), F.max("t").alias("last_year"), F.count("*").alias("n")).where("n >= 2")
    ends = ends.withColumn("change", F.col("last_value") - F.col("first_value"))
    moved = series.trend(x.withColumn("t", F.col("t").cast("double")), own).drop("n")
    same = [ends[c].eqNullSafe(moved[c]) for c in own]
    return ends.join(moved, same, "left").select(*(ends[c] for c in ends.columns), "ok", "reason", "direction", "p_value", "slope", "low", "high", "stability")


def town(records: DataFrame) -> DataFrame:
    """One row a place: years, span, counts and the panels (facility, parameter, unit) with their readings."""
    x = records.withColumn("facility_key", facility_key("facility", "place")).withColumn("year", F.substring("period", 1, 4).try_cast("int"))
    panel = x.groupBy("place", "facility_key", "parameter", "unit").agg(F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    panels = panel.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("facility_key", "parameter", "unit", "n", "first_year", "last_year"))).alias("panels"))
    head = x.groupBy("place").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("year")).alias("years"), F.count_distinct("identifier").alias("sources"))
    return head.join(panels, "place")


def went_quiet(silences: DataFrame, year: int | None = None) -> DataFrame:
    """Places that stopped reporting, optionally in one year, with the whole table's count of that year as a control."""
    x = silences.where("silent_since is not null").withColumn("same_year", F.count("*").over(Window.partitionBy("silent_since")))
    return x if year is None else x.where(F.col("silent_since") == year)


def frontier(read: DataFrame, links: DataFrame, coverage: DataFrame) -> DataFrame:
    """Questions (kind, subject, needs, have, value): five generators over what was read (place, year), river links (watercourse, upstream, downstream) and what the archive holds (place, year)."""
    known = read.where("place is not null and place <> ''").select(F.lower("place").alias("_p")).distinct()
    years = read.groupBy(F.lower("place").alias("_p")).agg(F.count_distinct("year").alias("got"))
    held = coverage.groupBy("place").agg(F.count_distinct("year").alias("n"), F.min("year").alias("a"), F.max("year").alias("b"))
    held = held.join(years, F.lower("place") == F.col("_p"), "left").withColumn("is_read", F.col("_p").isNotNull())
    none, one = F.array().cast("array<string>"), F.array("place")

    def split(rows: DataFrame, key: list[str]) -> DataFrame:
        x = rows.join(known, F.lower("place") == F.col("_p"), "left")
        return x.groupBy(*key).agg(F.sort_array(F.collect_set(F.when(F.col("_p").isNull(), F.col("place")))).alias("needs"), F.sort_array(F.collect_set(F.when(F.col("_p").isNotNull(), F.col("place")))).alias("have"))

    ends = links.select("watercourse", "upstream", "downstream", F.explode(F.array("upstream", "downstream")).alias("place"))
    down = split(ends, ["upstream", "downstream"]).select(F.lit("downstream").alias("kind"), F.concat_ws(" -> ", "upstream", "downstream").alias("subject"), "needs", "have", F.lit(3.0).alias("value"))
    river = split(ends.select("watercourse", "place").distinct(), ["watercourse"]).where("size(needs) + size(have) >= 3").select(F.lit("river").alias("kind"), F.col("watercourse").alias("subject"), "needs", "have", F.lit(5.0).alias("value"))
    told = F.col("is_read") & (F.col("got") >= TREND_YEARS)
    trend = held.where(F.col("n") >= TREND_YEARS).select(F.lit("trend").alias("kind"), F.col("place").alias("subject"), F.when(told, none).otherwise(one).alias("needs"), F.when(told, one).otherwise(none).alias("have"), F.lit(2.0).alias("value"))
    silence = held.where((F.col("b") < QUIET) & ~F.col("is_read")).select(F.lit("silence").alias("kind"), F.col("place").alias("subject"), one.alias("needs"), none.alias("have"), F.lit(1.5).alias("value"))
    # of several spellings of one town the shortest
    name = F.coalesce(town_name("place"), F.trim("place"))
    towns = read.where("place is not null and trim(place) <> ''").select(name.alias("place")).groupBy(F.lower("place").alias("k")).agg(F.min_by("place", F.struct(F.length("place"), "place")).alias("place"))
    decision = towns.select(F.lit("decision").alias("kind"), F.col("place").alias("subject"), F.array(F.concat("place", F.lit(" council minutes"))).alias("needs"), one.alias("have"), F.lit(2.5).alias("value"))
    return down.unionByName(trend).unionByName(river).unionByName(decision).unionByName(silence)


def show_page(records: DataFrame, key: str) -> DataFrame:
    """The reading of a recomputed content key."""
    from ledgerline.functions.keys import record_key

    return records.withColumn("key", record_key()).where(F.col("key") == key)
