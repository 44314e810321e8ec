"""Repairs of stored readings and of the catalogue; audits; quality gates of dimensions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import infer_year, language_codes

# Patterns of years and comparisons, facilities by title, letters that a scan mistakes for digits, scales of quantities.
READING_YEAR = re.compile(r"(?<!\d)(1[89]\d{2}|20[0-4]\d)(?!\d)")
COMPARES = re.compile(r"(?i)\b(compared\s+(?:with|to)|against|versus|vs\.?|in\s+contrast\s+(?:with|to)|an?\s+(?:increase|decrease)\s+(?:over|from))\b")
FACILITIES = (
    ("water pollution control|sewage treatment|sewage works|pollution control plant", "water pollution control plant"),
    ("drinking water surveillance|water supply system|water treatment plant|waterworks", "water supply system"),
    ("landfill|waste disposal", "waste site"),
    ("air quality|ambient air", "air monitoring"),
)
SCAN_LETTERS, SCAN_DIGITS = "Il|iOoQSsZBGT", "1111000552867"
SCALES = (("million gallons/day", "gallons/day", 1e6), ("million gallons", "gallons", 1e6), ("mil gal", "gallons", 1e6), ("thousand gallons", "gallons", 1e3), ("mgd", "gallons/day", 1e6))
RATES = (("daily", "day"), ("per day", "day"), ("/day", "day"), ("monthly", "month"), ("per month", "month"), ("/month", "month"), ("annual", "year"), ("yearly", "year"), ("per year", "year"), ("/year", "year"), ("hourly", "hour"), ("per hour", "hour"))


def nearest_year(quote: str | None, value: float | None) -> int | None:
    """Year that a comparing sentence attaches to a number: the nearest of two years or more, if the number stands there once."""
    if not quote or value is None or pd.isna(value) or not COMPARES.search(quote):
        return None
    years = [(m.start(), int(m[0])) for m in READING_YEAR.finditer(quote)]
    digits = [c for c in repr(float(value)).removesuffix(".0") if c.isdigit() or c == "."]
    if len({y for _, y in years}) < 2 or not digits:
        return None
    inside = lambda at: any(a <= at < a + 4 for a, _ in years)
    spans = [m.span() for m in re.finditer(r"\s*".join(map(re.escape, digits)), quote) if not inside(m.start())]
    if len(spans) != 1:
        return None
    (a, b), far = spans[0], lambda at: 0 if spans[0][0] <= at <= spans[0][1] else min(abs(at - a), abs(at - b))
    return min(years, key=lambda y: far(y[0]))[1]


def _nearest(quote: pd.Series, value: pd.Series) -> pd.Series:
    return pd.Series([nearest_year(q, v) for q, v in zip(quote, value, strict=True)], dtype="Int32")


def corrected_years(records: DataFrame, quote: str = "quote", value: str = "value", period: str = "period") -> DataFrame:
    """records with ``told`` (the year of the sentence) and ``outcome``: agree, abstain or change; a changed period is replaced."""
    x = records.withColumn("told", F.pandas_udf(_nearest, "int")(F.col(quote), F.col(value).cast("double")))
    same = F.substring(F.col(period), 1, 4) == F.col("told").cast("string")
    x = x.withColumn("outcome", F.when(F.col("told").isNull(), "abstain").when(F.coalesce(same, F.lit(False)), "agree").otherwise("change"))
    return x.withColumn(period, F.when(F.col("outcome") == "change", F.col("told").cast("string")).otherwise(F.col(period)))


def anchored_periods(records: DataFrame, items: DataFrame) -> DataFrame:
    """A period without a year (a month, a season) takes the year of its document, where the catalogue has one."""
    x = records.join(items.select("identifier", F.col("year").alias("_year")), "identifier", "left")
    bare = F.col("period").isNotNull() & (F.col("period") != "") & ~F.col("period").rlike(r"\d{4}") & F.col("_year").isNotNull()
    return x.withColumn("period", F.when(bare, F.concat(F.col("_year").cast("string"), F.lit(" "), F.col("period"))).otherwise(F.col("period"))).drop("_year")


def facility_of(title) -> Column:
    t = F.lower(F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit("")))
    out = F.when(F.lit(False), "")
    for pattern, name in FACILITIES:
        out = out.when(t.rlike(pattern), name)
    return out


def backfilled_facility(records: DataFrame, items: DataFrame) -> DataFrame:
    x = records.join(items.select("identifier", facility_of("title").alias("_f")), "identifier", "left")
    return x.withColumn("facility", F.coalesce(F.nullif(F.trim("facility"), F.lit("")), "_f")).drop("_f")


def metadata_proposals(items: DataFrame, least: float = 0.0) -> DataFrame:
    """(identifier, field, value, confidence) that a catalogue item (identifier, title, date, language, year) lacks."""
    language = items.withColumn("v", F.array_join(language_codes("language"), ";")).where("v <> '' and v <> coalesce(language, '')").select("identifier", F.lit("language").alias("field"), F.col("v").alias("value"), F.lit(0.999).alias("confidence"))
    g = items.where("year is null").withColumn("g", infer_year("title", "date")).where("g is not null")
    year = g.select("identifier", F.lit("year").alias("field"), F.col("g.year").cast("string").alias("value"), F.col("g.confidence").alias("confidence"))
    return language.unionByName(year).where(F.col("confidence") >= least)


def recovery_summary(guesses: DataFrame) -> DataFrame:
    """(basis, band, n, exact, near) of guesses (basis, confidence, year, truth); near: within a year."""
    band = F.when(F.col("confidence") >= 0.85, "high").when(F.col("confidence") >= 0.65, "medium").otherwise("low")
    return guesses.groupBy("basis", band.alias("band")).agg(F.count("*").alias("n"), F.count_if(F.col("year") == F.col("truth")).alias("exact"), F.count_if(F.abs(F.col("year") - F.col("truth")) <= 1).alias("near"))


def digit_stream(text) -> Column:
    """All digits of a page in order, letters that a scan mistakes for them put right."""
    return F.regexp_replace(F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SCAN_LETTERS, SCAN_DIGITS), r"\D", "")


def values_in_text(records: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total, found: how many of the values read from a page stand in its digits."""
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("value").cast("decimal(38,6)").cast("string"), r"\.?0+$", ""), r"\D", ""), "^0+", "")
    x = records.where("value is not null").join(pages.select(*keys, digit_stream("text").alias("_d")), keys, "left").withColumn("_v", digits)
    return x.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if((F.col("_v") != "") & F.contains("_d", "_v")).alias("found"))


def unit_text(unit) -> Column:
    """Spelling-insensitive form of a unit: dots, blanks and ``per`` folded."""
    u = F.lower(F.trim(F.replace(F.coalesce(F.col(unit) if isinstance(unit, str) else unit, F.lit("")), F.lit("."), F.lit(" "))))
    u = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(u, r"\s+", " "), r"\s*/\s*", "/"), r"\^", ""))
    return F.replace(u, F.lit(" per "), F.lit("/"))


def canonical_quantity(value, unit, parameter) -> Column:
    """Struct of value and unit with scales folded in and a rate that only the parameter's name tells put into the unit."""
    u, p = unit_text(unit), F.lower(F.coalesce(F.col(parameter) if isinstance(parameter, str) else parameter, F.lit("")))
    v = F.col(value) if isinstance(value, str) else value
    base, scale, rate = u, F.lit(1.0), F.lit(None).cast("string")
    for name, to, factor in reversed(SCALES):
        base, scale = F.when(u == name, F.lit(to)).otherwise(base), F.when(u == name, F.lit(factor)).otherwise(scale)
    for word, span in reversed(RATES):
        rate = F.when(p.contains(word), F.lit(span)).otherwise(rate)
    full = F.when(~base.contains("/") & rate.isNotNull() & v.isNotNull(), F.concat(base, F.lit("/"), rate)).otherwise(base)
    return F.struct((v * scale).alias("value"), full.alias("unit"))


def audit(records: DataFrame) -> DataFrame:
    """(flag, n) over records (resolved, q, value, unit, confidence, place, period): what would keep a reading out of a series."""
    flags = F.array_compact(F.array(
        F.when(F.col("resolved").isNull(), "unresolved parameter"),
        F.when(F.col("q").isNull() & (F.coalesce("unit", F.lit("")) != ""), "unknown unit"),
        F.when((F.col("q.base") == "%") & (F.col("value") > 100), "percent above 100"),
        F.when(F.col("value") < 0, "negative value"),
        F.when(F.coalesce("place", F.lit("")) == "", "no place"),
        F.when(~F.coalesce(F.col("period").rlike(r"^\d{4}"), F.lit(False)), "no year"),
        F.when(F.col("confidence") < 0.3, "low confidence"),
    ))
    return records.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def gazetteer_problems(rows: DataFrame, bounds: tuple[float, float, float, float], least: int, previous: int | None = None) -> DataFrame:
    """(problem, n): what forbids publishing a gazetteer: bad ids, duplicates, coordinates out of bounds, too few rows, a drop below four fifths."""
    south, north, west, east = bounds
    x = rows.withColumn("_n", F.count("*").over(Window.partitionBy("id")))
    inside = F.col("lat").between(south, north) & F.col("lon").between(west, east)
    said = F.array_compact(F.array(F.when(~F.coalesce(F.col("id").rlike(r"^[A-Z0-9]+$"), F.lit(False)), "bad id"), F.when(F.col("_n") > 1, "duplicate id"), F.when(~F.coalesce(inside, F.lit(False)), "out of bounds"), F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "no name")))
    bad = x.select(F.explode(said).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))
    few = rows.agg(F.count("*").alias("n")).select(F.when(F.col("n") < least, "too few rows").when(F.col("n") < F.lit(0.8 * (previous or 0)), "shrunk below four fifths").alias("problem"), "n").where("problem is not null")
    return bad.unionByName(few)


def alias_problems(entries: DataFrame) -> DataFrame:
    """(problem, name) of alias entries (names, canonical, lat, lon, source): half a coordinate, a coordinate without source, a name twice."""
    half = entries.where(F.col("lat").isNull() != F.col("lon").isNull()).select(F.lit("only one coordinate").alias("problem"), F.col("canonical").alias("name"))
    bare = entries.where("lat is not null and coalesce(source, '') = ''").select(F.lit("coordinate without source").alias("problem"), F.col("canonical").alias("name"))
    twice = entries.select("canonical", F.explode("names").alias("n")).groupBy(F.lower("n").alias("name")).agg(F.count_distinct("canonical").alias("k")).where("k > 1").select(F.lit("duplicate name").alias("problem"), "name")
    return half.unionByName(bare).unionByName(twice)


def not_done(pages: DataFrame, attempted: DataFrame, keys: list[str]) -> DataFrame:
    """Pages that no earlier run has attempted: the resume set."""
    return pages.join(attempted.select(*keys).distinct(), keys, "left_anti")


def shelves(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with ``heading``: the group's name on the first row of each run."""
    before = F.lag(group).over(Window.partitionBy("place").orderBy(*order))
    return rows.withColumn("heading", F.when(~before.eqNullSafe(F.col(group)), F.col(group)))


def human_number(v: float | None) -> str:
    """Four significant digits; no exponent between a ten-thousandth and a billion; thousands apart."""
    if v is None or isinstance(v, bool) or pd.isna(v):
        return ""
    text = f"{v:.4g}"
    if v and not 1e-4 <= abs(v) < 1e9:
        return text
    if "e" in text:
        text = f"{float(text):f}".rstrip("0").rstrip(".")
    whole, dot, rest = text.partition(".")
    return f"{int(whole):,}{dot}{rest}"


def _numbers(v: pd.Series) -> pd.Series:
    return v.map(human_number)


def readable(v) -> Column:
    return F.pandas_udf(_numbers, "string")(v)
