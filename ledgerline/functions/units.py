"""Units: text to a base unit, multiplier, dimension and what was assumed, as Column expressions.

An unknown unit gives null.  Nothing is coerced: two quantities compare only if
their base units agree, and the refusal says why.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit spellings, scale words and conversion factors.
IMPERIAL_GALLON = 1.20095
SCALE_WORDS = (("million", 1e6), ("mil", 1e6), ("thousand", 1e3), ("k", 1e3), ("billion", 1e9))
PPM_NOTE = "ppm treated as mg/L (valid for dilute aqueous samples)"
MGD_NOTE = "MGD read as million Imperial gallons/day"
IMPERIAL_NOTE = "Imperial gallons converted to US gallons"
MG_NOTE = '"mg" read as million gallons (Ontario waterworks usage of the era)'
#: (pattern of the cleaned text, multiplier, base unit, dimension, note)
RULES = (
    (r"mg\s*/\s*[l1i]|mgl|mg per litre|mg per liter", 1.0, "mg/l", "concentration", None),
    (r"(u|µ|mc)g\s*/\s*[l1i]|ugl|ug per litre", 1e-3, "mg/l", "concentration", None),
    (r"ng\s*/\s*[l1i]", 1e-6, "mg/l", "concentration", None),
    (r"ppm|p\.p\.m|parts per million", 1.0, "mg/l", "concentration", PPM_NOTE),
    (r"%|percent|per cent|pct", 1.0, "%", "fraction", None),
    (r"cu ft|cuft|cubic feet|ft3|cu\. ft", 1.0, "cuft", "volume", None),
    (r"lb|lbs|pounds?", 1.0, "lb", "mass", None),
    (r"(lb|lbs|pounds?)\s*/?\s*(per\s*)?day", 1.0, "lb/day", "mass_rate", None),
    (r"ph|ph units?", 1.0, "ph", "ph", None),
    (r"umhos?/cm|us/cm|micromhos/cm|microsiemens/cm", 1.0, "us/cm", "conductivity", None),
    (r"°?c|deg c|degrees c|celsius", 1.0, "c", "temperature", None),
    (r"tons?|tonnes?", 1.0, "tonne", "mass", None),
    (r"hp|horsepower", 1.0, "hp", "power", None),
    (r"[nfj]tu", 1.0, "ntu", "turbidity", None),
    (r"persons?|people|population", 1.0, "person", "count", None),
    (r"mins?|minutes?", 1.0, "min", "time", None),
    (r"hrs?|hours?", 1.0, "hour", "time", None),
    (r"ft|feet|foot", 1.0, "ft", "length", None),
    (r"\$|dollars|cad", 1.0, "$", "currency", None),
)


def clean(unit) -> Column:
    t = F.replace(F.replace(F.lower(F.trim(unit)), F.lit("imp."), F.lit("imperial")), F.lit("imp "), F.lit("imperial "))
    return F.btrim(F.regexp_replace(F.regexp_replace(t, "[()]", " "), r"\s+", " "), F.lit(" ."))


def _found(value, unit: str, dimension: str, *notes) -> Column:
    kept = F.array_compact(F.array(*(n if isinstance(n, Column) else F.lit(n) for n in notes))) if notes else F.array().cast("array<string>")
    return F.struct(value.cast("double").alias("multiplier"), F.lit(unit).alias("base"), F.lit(dimension).alias("dimension"), kept.alias("assumptions"))


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_unit(unit, era=None, flow=None) -> Column:
    """Struct of multiplier, base, dimension, assumptions; null for an unknown unit.

    era: the year of the document.  flow: ``rate`` or ``total`` where the parameter
    is a flow, which is the only thing that can tell what a bare ``mg`` means.
    """
    unit = F.col(unit) if isinstance(unit, str) else unit
    era = F.lit(None).cast("int") if era is None else (F.col(era) if isinstance(era, str) else era)
    flow = F.lit(None).cast("string") if flow is None else (F.col(flow) if isinstance(flow, str) else flow)
    def scaled(t: Column) -> Column:
        scale, rest = F.lit(1.0), t
        for word, factor in reversed(SCALE_WORDS):  # the first word of the list that occurs is the one that counts
            has = t.rlike(rf"\b{word}\b")
            scale = F.when(has, F.lit(factor)).otherwise(scale)
            rest = F.when(has, F.trim(F.regexp_replace(t, rf"\b{word}\b", " "))).otherwise(rest)
        return _let(F.struct(scale.alias("scale"), rest.alias("rest")), named)

    def named(s: Column) -> Column:
        rest = F.trim(F.regexp_replace(F.replace(s["rest"], F.lit("imperial"), F.lit(" ")), r"\s+", " "))
        return _let(F.struct(s["scale"].alias("scale"), rest.alias("rest"), s["rest"].contains("imperial").alias("imperial")), ruled)

    def ruled(s: Column) -> Column:
        rest, scale, imperial = s["rest"], s["scale"], s["imperial"]
        gallons = F.when(imperial, F.lit(IMPERIAL_GALLON)).otherwise(F.lit(1.0))
        note = F.when(imperial, F.lit(IMPERIAL_NOTE))
        old = F.concat(F.lit("unqualified 'gallons' in a "), era.cast("string"), F.lit(" Canadian report is probably Imperial; NOT converted"))
        whole = lambda p: rest.rlike(f"^(?:{p})$")
        out = F.when(whole("mg") & (flow == "total"), _found(scale * 1e6, "gal", "volume", F.when(era < 1980, old), MG_NOTE))
        out = out.when(whole("mg") & (flow == "rate"), _found(scale * 1e6, "gal/day", "flow", MG_NOTE))
        for pattern, factor, base, dimension, said in RULES[:5]:
            out = out.when(whole(pattern), _found(scale * factor, base, dimension, *([said] if said else [])))
        out = out.when(whole("mgd|mg/d"), _found(scale * 1e6 * IMPERIAL_GALLON, "gal/day", "flow", MGD_NOTE))
        out = out.when(whole(r"gal(lons)?\s*/?\s*(per\s*)?day"), _found(scale * gallons, "gal/day", "flow", note))
        out = out.when(whole(r"gal(lons)?"), _found(scale * gallons, "gal", "volume", note, F.when(~imperial & (era < 1980), old)))
        for pattern, factor, base, dimension, said in RULES[5:]:
            out = out.when(whole(pattern), _found(scale * factor, base, dimension, *([said] if said else [])))
        return out

    return F.when(F.coalesce(clean(unit), F.lit("")) != "", _let(clean(unit), scaled))


def comparable(a, b) -> Column:
    """Struct of verdict and reason for two parsed units."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    notes = F.array_distinct(F.concat(a["assumptions"], b["assumptions"]))
    said = F.when(F.size(notes) > 0, F.concat(F.lit("comparable, but note: "), F.array_join(notes, "; "))).otherwise(F.lit("comparable"))
    answer = lambda ok, why: F.struct(F.lit(ok).alias("ok"), why.alias("reason"))
    return (
        F.when(a.isNull() | b.isNull(), answer(False, F.lit("one of the units was not recognised")))
        .when(a["dimension"] != b["dimension"], answer(False, F.concat(a["base"], F.lit(" is a "), a["dimension"], F.lit(" and "), b["base"], F.lit(" is a "), b["dimension"], F.lit("; converting between them needs information the document does not give"))))
        .when(a["base"] != b["base"], answer(False, F.concat(F.lit("same dimension but different base units ("), a["base"], F.lit(" vs "), b["base"], F.lit(")"))))
        .otherwise(answer(True, said))
    )
