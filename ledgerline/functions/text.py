"""Text expressions: evidence tokens, page signals, catalogue repair, titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and lists.
WORD = r"[A-Za-z]{3,}"
NUMBER = r"-?\d[\d,]*\.?\d*"
UNIT = r"(?i)\b(mg/[lL1]|ug/m3?|µg/m3?|ppm|ppb|mgd|m3/d|cfs|cu\.?\s?ft|gal(?:lons)?|mg/kg|kg/ha|tonnes?|hectares?|acres?|°[CF]|per ?cent|%)\b"
STANDARD = r"(?i)\b(maximum acceptable concentration|objective|criteri(?:on|a)|guideline|standard|limit|shall not exceed|must not exceed|permissible|recommended (?:level|concentration)|MAC\b|ODWO)\b"
FIGURE = r"(?i)\b(figure|fig\.|graph|plotted|plot of|curve|histogram|chart)\s*\.?\s*\d*"
MAP = r"(?i)\b(map|scale 1[:\s]|1:\d{3,}|legend|contour|latitude|longitude|UTM|township|concession|quadrangle|sheet \d)\b"
BOILERPLATE = r"(?im)(digitized by the internet archive|copyright provisions|table of contents|this page intentionally|library and archives|call number|^\s*contents\s*$)"
COUNTED_NOUNS = (
    "schools?", "pupils?", "students?", "teachers?", "classrooms?", "graduates?", "candidates?", "dwellings?", "households?", "families", "persons?", "people", "residents?", "inhabitants?",
    "beds?", "patients?", "physicians?", "nurses?", "hospitals?", "farms?", "cattle", "swine", "poultry", "livestock", "head", "bushels?", "employees?", "workers?", "members?", "officers?", "staff",
    "births?", "deaths?", "cases?", "complaints?", "applications?", "appeals?", "convictions?", "vehicles?", "accidents?", "licen[cs]es?", "permits?", "claims?",
    "lots?", "units?", "rooms?", "buildings?", "plants?", "wells?", "mines?", "municipalities", "townships?", "counties", "libraries", "volumes?",
)
COUNTED = r"(?i)\b\d[\d,]*\s+(?:\w+\s+){0,3}?(" + "|".join(COUNTED_NOUNS) + r")\b"
LANGUAGES = {"en": "eng", "fr": "fre", "de": "ger", "es": "spa", "english": "eng", "french": "fre", "german": "ger", "spanish": "spa", "eng": "eng", "fre": "fre", "fra": "fre", "ger": "ger", "deu": "ger", "spa": "spa"}
NARROW, WIDE = 4, 8


def _hits(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def page_signals(text) -> Column:
    """Struct of counts and ratios that say what kind of page a text is."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    lines = F.when(F.size(lines) == 0, F.array(text)).otherwise(lines)
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  body(value), evaluated once
    per_line = F.transform(lines, lambda x: F.struct(_hits(x, WORD).alias("w"), _hits(x, NUMBER).alias("n")))

    def shaped(per: Column, counts: Column) -> Column:
        k = F.size(counts)
        median = (F.element_at(counts, ((k + 1) / 2).cast("int")) + F.element_at(counts, (k / 2 + 1).cast("int"))) / 2.0
        width = F.greatest(F.lit(NARROW), F.least(F.lit(WIDE), median)).cast("int")

        def ratios(w: Column) -> Column:
            prose = F.size(F.filter(per, lambda x: (x["w"] >= w) & (x["n"] <= 3)))
            table = F.size(F.filter(per, lambda x: (x["n"] >= 5) & (x["w"] <= 4)))
            return F.struct((prose / k).alias("prose"), (table / k).alias("table"), w.alias("width"))

        return let(width, ratios)

    shape = let(per_line, lambda per: let(F.array_sort(F.transform(per, lambda x: x["w"])), lambda counts: shaped(per, counts)))
    # what is left when runs of other characters go: one match a run, not one a character
    digits, letters = (F.length(F.regexp_replace(text, rf"[^\p{{{c}}}]+", "")) for c in ("Nd", "L"))
    return let(shape, lambda s: F.struct(
        F.length(text).alias("chars"), _hits(text, WORD).alias("words"), _hits(text, NUMBER).alias("numbers"), (digits / F.greatest(F.lit(1), digits + letters)).alias("digit_ratio"),
        s["prose"].alias("prose_ratio"), s["table"].alias("table_ratio"), s["width"].alias("line_width"), (_hits(text, UNIT) + _hits(text, COUNTED)).alias("unit_hits"),
        _hits(text, STANDARD).alias("standard_hits"), _hits(text, FIGURE).alias("figure_hits"), _hits(text, MAP).alias("map_hits"), text.rlike(BOILERPLATE).alias("boilerplate"),
    ))


def page_routes(s: str) -> Column:
    """Array of paths for a column of page signals: prose, standard, table, figure, map, or skip."""
    c = lambda n: F.col(f"{s}.{n}")
    units = c("unit_hits") > 0
    some = F.array_compact(F.array(
        F.when((c("prose_ratio") >= 0.15) & units, "prose"),
        F.when((c("standard_hits") >= 1) & units, "standard"),
        F.when((c("table_ratio") >= 0.08) | ((c("digit_ratio") >= 0.30) & (c("numbers") >= 20)), "table"),
        F.when((c("figure_hits") >= 1) & (c("digit_ratio") < 0.30), "figure"),
        F.when(c("map_hits") >= 3, "map"),
    ))
    last = F.when((c("prose_ratio") >= 0.30) & (c("numbers") >= 3), F.array(F.lit("prose"))).otherwise(F.array(F.lit("skip")))
    return (
        F.when((c("map_hits") >= 2) & (c("chars") < 1200), F.array(F.lit("map")))
        .when((c("chars") < 120) | (c("boilerplate") & (c("numbers") < 5)), F.array(F.lit("skip")))
        .when(F.size(some) > 0, some)
        .otherwise(last)
    )


NUMBER_TOKEN = r"(?<![\w.])[+\-−]?(?:\d{1,3}(?:,\s*\d{3})+(?:\.\s*\d+)?|\d+\.\s*\d+|\.\s*\d+|\d+)(?!\w|\.\s*\d)"
#: Words first: the alternatives never begin alike, and most tokens are words.
EVIDENCE = rf"(?U)(\p{{L}}+(?:['’]\p{{L}}+)?|{NUMBER_TOKEN}|\+/-|<=|>=|[<>≤≥±%=£$€])"


def evidence_tokens(text) -> Column:
    """Array of tokens that carry meaning: signs, canonical numbers, words; layout and punctuation are dropped.

    A number keeps its point and its sign, whatever blanks a scan put after its punctuation.
    """
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))

    def name(x: Column) -> Column:
        number = F.regexp_replace(F.replace(x, F.lit("−"), F.lit("-")), r"[\s,]", "")
        number = F.when(number.contains("."), F.regexp_replace(number, r"\.?0+$", "")).otherwise(number)
        number = F.regexp_replace(number, r"^([-+]?)0*(?=\d)", "$1")
        number = F.regexp_replace(F.regexp_replace(number, r"^([-+]?)(?=\.|$)", "${1}0"), r"^-0$", "0")
        sign = F.when(x == "≤", "<=").when(x == "≥", ">=").when(x == "+/-", "±").otherwise(x)
        return F.when(x.rlike(r"\d"), F.concat(F.lit("number:"), number)).when(x.rlike(r"^\p{L}"), F.concat(F.lit("word:"), F.lower(F.replace(x, F.lit("’"), F.lit("'"))))).otherwise(F.concat(F.lit("semantic:"), sign))

    return F.transform(F.regexp_extract_all(text, F.lit(EVIDENCE), F.lit(1)), name)


def contains_run(page_tokens, quote_tokens) -> Column:
    """Whether a page's tokens hold the quote's as one run, with no sign right beside it that the quote left out."""
    mark = chr(31)
    page = F.concat(F.lit(mark), F.array_join(page_tokens, mark), F.lit(mark))
    quote = F.concat(F.lit(mark), F.array_join(quote_tokens, mark), F.lit(mark))
    parts = F.split(page, F.concat(F.lit(r"\Q"), quote, F.lit(r"\E")))
    free = F.exists(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: ~F.element_at(parts, i).rlike(rf"{mark}?semantic:[^{mark}]+$") & ~F.element_at(parts, i + 1).rlike(rf"^semantic:"))
    return (F.size(quote_tokens) > 0) & page.contains(quote) & F.when(F.size(parts) > 1, free).otherwise(F.lit(False))


def distinctive(quote_tokens, least: int = 4) -> Column:
    return F.size(quote_tokens) >= least


def has_prose(tokens) -> Column:
    return F.exists(tokens, lambda t: t.startswith("word:"))


def repaired_digits(text) -> Column:
    """Text with letters that a scan took for digits put right, inside runs that hold a digit (up to 40 characters of such letters on either side)."""
    text = F.col(text) if isinstance(text, str) else text
    beside = lambda letters: rf"(?<=[0-9][IlO|]{{0,40}})[{letters}]|[{letters}](?=[IlO|]{{0,40}}[0-9])"
    return F.regexp_replace(F.regexp_replace(text, beside("Il|"), "1"), beside("O"), "0")


def numbers_in(text) -> Column:
    """Array of the numbers a text states; before thousand, million or billion also the scaled one."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    found = F.regexp_extract_all(text, F.lit(rf"(?iU)({NUMBER_TOKEN}(?:\s*(?:thousand|million|billion)s?\b)?)"), F.lit(1))
    value = lambda x: F.regexp_replace(F.replace(F.regexp_extract(x, r"^[^a-zA-Z]+", 0), F.lit("−"), F.lit("-")), r"[\s,]", "").try_cast("double")
    scale = lambda x: F.when(x.rlike("(?i)thousand"), 1e3).when(x.rlike("(?i)million"), 1e6).when(x.rlike("(?i)billion"), 1e9)
    return F.flatten(F.transform(found, lambda x: F.array_compact(F.array(value(x), value(x) * scale(x)))))


def language_codes(raw) -> Column:
    """Array of ISO 639-2 codes of a language field; what is not known is left out."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    known = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    parts = F.split(F.lower(F.coalesce(raw, F.lit(""))), r"[^a-z]+")
    return F.array_distinct(F.array_compact(F.transform(parts, lambda x: F.try_element_at(known, x))))


def infer_year(title, date=None) -> Column:
    """Struct of year, basis and confidence from a date field, else from a title: a range gives its end, several years the last."""
    title = F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit(""))
    year = r"(?<!\d)(1[7-9]\d\d|20[0-2]\d)(?!\d)"
    pack = lambda y, basis, c: F.struct(y.cast("int").alias("year"), F.lit(basis).alias("basis"), F.lit(c).alias("confidence"))
    date = F.lit(None).cast("string") if date is None else (F.col(date) if isinstance(date, str) else date)
    of_date = F.regexp_extract(F.coalesce(date, F.lit("")), year, 1)
    span = F.regexp_extract(title, rf"{year}\s*[-–/]\s*(1[7-9]\d\d|20[0-2]\d)(?!\d)", 2)
    every = F.array_distinct(F.regexp_extract_all(title, F.lit(year), F.lit(1)))
    return F.when(of_date != "", pack(of_date, "date field", 0.95)).when(span != "", pack(span, "title range", 0.55)).when(F.size(every) == 1, pack(F.get(every, 0), "title", 0.9)).when(F.size(every) > 1, pack(F.array_max(every), "several in title", 0.4))


def period_risk(quote, period) -> Column:
    """Struct of the other years that a quote names and whether it compares them."""
    quote = F.coalesce(F.col(quote) if isinstance(quote, str) else quote, F.lit(""))
    period = F.coalesce(F.col(period) if isinstance(period, str) else period, F.lit(""))
    years = F.array_distinct(F.regexp_extract_all(quote, F.lit(r"(?<!\d)(1[89]\d\d|20[0-4]\d)(?!\d)"), F.lit(1)))
    others = F.array_except(years, F.array(F.substring(period, 1, 4)))
    return F.struct(others.alias("others"), (F.size(others) > 0).alias("at_risk"), quote.rlike(r"(?i)\b(compared|than|previous|increase|decrease|versus|from \d{4} to)\b").alias("compares"))


def search_tokens(text) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) > 1)


def lenient_number(text) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.nullif(F.regexp_extract(F.regexp_replace(text, r"[,$\s]", ""), r"-?\d+(\.\d+)?", 0), F.lit("")).try_cast("double")


def watercourse(station) -> Column:
    """River of a gauge's name, its place dropped; null without a word for water."""
    t = F.upper(F.trim(F.col(station) if isinstance(station, str) else station))
    river = F.trim(F.regexp_replace(t, r"\s+(AT|NEAR|ABOVE|BELOW|UPSTREAM|DOWNSTREAM|ABV|BLW|IN)\s+.*$", ""))
    return F.when(river.rlike(r"\b(RIVER|CREEK|BROOK|LAKE|STREAM|CANAL|BAY|HARBOUR)\b"), river)
