"""Identity of readings, claims and bundles, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT_FIELDS = ("place", "facility", "parameter", "unit", "period", "stream", "kind", "qualifier", "condition")


def blank(c) -> Column:
    """Null, missing and empty are one value in every key."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def slug(c) -> Column:
    return F.btrim(F.regexp_replace(F.lower(blank(c)), "[^a-z0-9]+", "-"), F.lit("-"))


def number_text(v) -> Column:
    """Shortest text of a number: whole ones without a fraction, exponents as e+16 and e-05, zero unsigned."""
    v = F.col(v) if isinstance(v, str) else v
    v = v.cast("double")
    raw = v.cast("string")
    mantissa, power = F.regexp_replace(F.split_part(raw, F.lit("E"), F.lit(1)), r"\.0$", ""), F.split_part(raw, F.lit("E"), F.lit(2))
    digits = F.lpad(F.regexp_replace(power, "^-", ""), 2, "0")
    scientific = F.concat(mantissa, F.when(power.startswith("-"), F.lit("e-")).otherwise(F.lit("e+")), digits)
    plain = F.regexp_replace(F.format_string("%.20f", v), r"\.?0+$", "")
    whole = F.abs(v) < 1e15
    return (
        F.when(v.isNull(), F.lit("None"))
        .when(F.isnan(v), F.lit("nan"))
        .when(v == 0, F.lit("0"))
        .when((v == F.floor(v)) & whole, F.floor(v).cast("bigint").cast("string"))
        .when((v == F.floor(v)) & (F.abs(v) < 9e18), v.cast("decimal(38,0)").cast("string"))
        .when(raw.contains("E") & (F.abs(v) >= 1e-4) & (F.abs(v) < 1e-3), plain)
        .when(raw.contains("E"), scientific)
        .otherwise(raw)
    )


def record_key(kind="kind", parameter="parameter", value="value", unit="unit", qualifier="qualifier", stream="stream", place="place", facility="facility", period="period", identifier="identifier", page="page", condition="condition") -> Column:
    """Content identity of a reading: 20 hex digits of the SHA-256 of its joined fields; the condition counts only when there is one."""
    side = F.when(blank(stream) == "", F.lit("unknown")).otherwise(blank(stream))
    parts = [blank(kind), slug(parameter), number_text(value), slug(unit), blank(qualifier), side, slug(place), slug(facility), blank(period), blank(identifier), blank(page)]
    text = F.concat_ws("|", *parts)
    when = slug(condition)
    return F.substring(F.sha2(F.when(when == "", text).otherwise(F.concat(text, F.lit("|"), when)).cast("binary"), 256), 1, 20)


def slot_key(**columns) -> Column:
    """What a claim is about: nine lower-cased fields joined by bars, place first, condition last."""
    return F.concat_ws("|", *(F.lower(F.trim(blank(columns.get(f, f)))) for f in SLOT_FIELDS))


def bundle_key(keys) -> Column:
    """Aggregate: 16 hex digits over the sorted record keys."""
    return F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list(keys)), "|").cast("binary"), 256), 1, 16)


def claim_key(identifier, page, quote, key, slot) -> Column:
    text = F.to_json(F.struct(blank(identifier).alias("i"), blank(key).alias("k"), blank(page).alias("p"), F.substring(blank(quote), 1, 200).alias("q"), blank(slot).alias("s")))
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def item_url(base: str, identifier="identifier") -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/details/"), F.col(identifier))


def page_url(base: str, identifier="identifier", page="page") -> Column:
    """Address of a page image; pages count from one, its address from zero."""
    return F.when(F.col(page).isNull(), item_url(base, identifier)).otherwise(F.concat(item_url(base, identifier), F.lit("/page/n"), (F.col(page) - 1).cast("string")))


def visitor_tag(salt: str, peer) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), blank(peer)).cast("binary"), 256), 1, 12)


def safe_identifier(c) -> Column:
    """Whether an identifier can name a file anywhere."""
    c = F.col(c) if isinstance(c, str) else c
    device = c.rlike(r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$")
    return F.coalesce(c.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") & ~device & ~c.endswith("."), F.lit(False))
