"""Year of publication from a document's own text.

A page is read line by line in one Arrow batch function, which yields candidate years
as rows; which of them is the answer is then aggregation.  There are five tiers:
copyright, publication and revision lines; the date of a covering letter; a date on
the front pages; the period of an annual report; years in tables, which only bound
the answer from below.  The best tier decides, and evidence that conflicts gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The span of the collection, years, months and dates.
FIRST, LAST = 1841, 2013
YEAR_TEXT = r"(?:184[1-9]|18[5-9]\d|19\d{2}|200\d|201[0-3])"
YEAR = re.compile(rf"(?<![A-Za-z0-9.])(?P<year>{YEAR_TEXT})(?![A-Za-z0-9])")
RANGE = re.compile(rf"(?<![A-Za-z0-9.])(?P<first>{YEAR_TEXT})\s*[-/–—]\s*(?P<last>{YEAR_TEXT})(?![A-Za-z0-9])")
MONTH = (
    r"jan(?:uary|vier)?|feb(?:ruary)?|mar(?:ch|s)?|apr(?:il)?|may|jun(?:e|in)?|jul(?:y|let)?|aug(?:ust)?|sep(?:t(?:ember|embre)?)?|oct(?:ober|obre)?|nov(?:ember|embre)?|dec(?:ember|embre)?"
    r"|f[ée]vrier|avril|mai|juin|juillet|ao[ûu]t|d[ée]cembre"
)
MONTH_YEAR = re.compile(rf"(?i)(?<![A-Za-z])(?:{MONTH})\.?\s*,?\s*(?P<year>{YEAR_TEXT})(?![A-Za-z0-9])")
FULL_DATE = re.compile(rf"(?i)(?:(?:{MONTH})\.?\s+\d{{1,2}}(?:st|nd|rd|th|er)?\s*,?\s*{YEAR_TEXT}(?![A-Za-z0-9])|(?:le\s+)?\d{{1,2}}(?:st|nd|rd|th|er)?\s+(?:{MONTH})\.?\s*,?\s*{YEAR_TEXT}(?![A-Za-z0-9]))")
ONLY_YEAR = re.compile(rf"^\s*(?P<year>{YEAR_TEXT})\s*[.,;:]?\s*$")
STAMP = re.compile(rf"(?i)\s*(?:\d{{1,4}}\s*[,;:-]?\s*)?(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|SEPT|OCT|NOV|DEC)\.?\s+\d{{1,2}}\s+{YEAR_TEXT}\s*(?:\.\.\.)?[-.]*\s*")
WEEKDAY = re.compile(r"(?i)^\s*(?:mon(?:day)?|tue(?:sday)?|wed(?:nesday)?|thu(?:rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)\b")

# What labels a date, and what makes it none.
_GOVERNMENT = r"crown|queen|king|government|ministry|minister|printer|canada|ontario"
_COPIES = r"(?i)\s+(?:copies|reports?|articles?|brochures?|editions?|impressions?|leaflets?|booklets?)\b"
COPYRIGHT = re.compile(r"(?i)\b(?:copyright|copr\.?)\b|droits?\s+d")
PUBLICATION = re.compile(
    r"(?i)^\s*[^A-Za-z0-9]{0,5}(?:published\b|printed\b|publication\s+date\b|date\s+de\s+publication\b|publi(?:e|é)e?\b|imprim(?:e|é)e?\b|d(?:e|é)p[oô]t\s+l(?:e|é)gal\b"
    r"|(?:queen|king)['’]s\s+printer\b|imprimeur\s+(?:de\s+la\s+reine|du\s+roi)\b|minister\s+of\s+supply\s+and\s+services\s+canada\b)"
)
IMPRINT = re.compile(r"(?i)(?:queen|king).?s\s+printer|imprimeur|minister\s+of\s+supply")
REVISION = re.compile(r"(?i)^\s*(?:revised|revision|reprinted|(?:first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|\d+(?:st|nd|rd|th))\s+printing|printing\s*(?:date)?|edition)\b")
ANNUAL = re.compile(
    r"(?i)\bannual\s+report\b|\brapport\s+annuel\b|^\s*reporting\s+(?:year|period)\s*[:.-]|^\s*(?:report\s+)?for\s+the\s+year\s+ended\b|^\s*fiscal\s+year\s+(?:ended|ending)\b"
    r"|\bfinancial\s+statements?\s+for\s+the\s+year\s+ended\b|^\s*this\s+report\s+(?:contains|presents?)\b[^\n]{0,100}\bfor\b"
)
PERIOD_TITLE = re.compile(rf"(?i)^\s*{YEAR_TEXT}\s+(?:[A-Z&'’-]+\s+){{0,8}}REPORT\b|^\s*(?:REPORT|BULLETIN)\s+(?:FOR\s+)?{YEAR_TEXT}\b")
PERIOD_ENDED = re.compile(r"(?i)^\s*(?:(?:financial\s+statements?\s+)?(?:report\s+)?for\s+the\s+year\s+ended\b|fiscal\s+year\s+(?:ended|ending)\b)")
ADDRESSEE = re.compile(r"(?i)\bdear\b|\bmonsieur\b|\bmadame\b|\bthe\s+honou?rable\b|\bto\s*:\s*(?:the\s+)?(?:chair|minister|commissioner)")
TRANSMITTAL = re.compile(
    r"(?i)\bi\s+have\s+the\s+honou?r\b|\bj['’]ai\s+l['’]honneur\b|\benclosed\b|\bi\s+(?:enclose|submit|transmit)\b|\bsoumettre\b|\byours\s+(?:truly|sincerely|faithfully)\b|\brespectfully\b|\bsalutations\s+distingu[ée]es\b"
)
BALANCE = re.compile(r"(?i)\bbalance\b|\bas\s+at\b")
DIGITAL = re.compile(r"(?i)digitiz|digitis|scann(?:ed|ing)|upload(?:ed|ing)?|internet\s+archive|archive\.org|electronic\s+edition|funding\s+from")
FUTURE = re.compile(r"(?i)project(?:ed|ion)|forecast|planned|proposed|scenario|target|anticipated|future|pro\s+forma|estimated|estimate\s+for|\b(?:bibliography|references|literature\s+cited)\b")
TABLE, CONTENTS = re.compile(r"(?i)\b(?:table|tableau)\s+[A-Z0-9IVX.-]+"), re.compile(r"(?i)\btable\s+of\s+contents\b|table\s+des\s+mati")
NUMBER = re.compile(r"(?<![A-Za-z])[-+]?\d+(?:[.,]\d+)?(?![A-Za-z])")
EVENT_RECORD = re.compile(
    r"(?i)\bagendas?\s*/?\s*minutes\b|\bcommittee\s+agendas?\b|\b(?:meeting|minutes|agenda)\s+of\b|\b(?:meeting|committee)\s+agenda\b|\b(?:inaugural|regular|special)\s+meeting\b|\bcouncil\s+met\b"
    r"|\bby[-\s]?law\s+(?:no\.?|number)\b|\bto\s+amend\s+.*by[-\s]?law\b"
)
NOT_FRONT = re.compile(
    r"(?i)\blist\s+of\s+(?:tables|figures|appendices)\b|\bsampling\s+(?:site|date)s?\b|\bmeeting\s+of\b|\bcouncil\s+met\b|\bminutes\s+of\b|\bcommittee\s+meeting\b|\bresults?\s+of\s+voting\b"
    r"|\b(?:letter|correspondence)\s+(?:from|to)\b|\b(?:public\s+)?hearing\b|\bagenda\b|\b(?:first|second|third|1st|2nd|3rd)\s+reading\b|\b(?:map|drawing)\s+(?:no\.?|number|date)\b|\bdrawn\s+by\b"
    r"|\bscale\s*(?:[:=]|1\s*:)|\b(?:diagnosis|necropsy|histopathology)\b|\b(?:appointed|entered\s+civic\s+service)\b"
)
OTHER_DATE = re.compile(
    r"(?i)\b(?:resigned|retired|appointed|born|died|effective)\b|\b(?:capacity|statistics?|sampling|measurements?)\b|\bfiscal\s+year\s+(?:ended|ending)\b|\b(?:reading|lecture)\b|\b(?:as\s+of|as\s+at|through|until|up\s+to|jusqu)\b"
)
CITED = re.compile(r"(?i)\b(?:following\s+)?extract\s+from\b|\breference\s+paper\b|\bliterature\s+cited\b|\b(?:bibliography|catalogue|catalog)\b|\b(?:list|index)\s+of\s+(?:reports?|publications?|references?)\b")
FORM = re.compile(r"(?i)\b(?:yes|no)\s*(?:[xX]|___+)?\b|\bquestionnaire\b|\brules?\s+and\s+regulations?\b")
BEFORE_ID = re.compile(r"(?:(?:project|contract|station|site|sample|file|drawing|job|account|specification|catalogue|catalog|cat\.?|inventory|isbn|issn|accession)\s*(?:no\.?|number|#)?|report\s*(?:no\.?|number|#))\s*[A-Za-z0-9./:-]*$")
AFTER_QUANTITY = re.compile(r"\s*(?:gal|gallons?|mg|kg|lb|lbs|m3|m³|ft|feet|litres?|liters?|l/day|mg/l|ppm|ppb|cfs|kw|volts?)\b|\s+(?:street|st\.?|road|rd\.?|avenue|ave\.?|boulevard|blvd\.?|drive|dr\.?|highway|hwy\.?|route)\b")
LINE_IS_NONE = re.compile(r"\bcopyright\s+act\b|\b(?:received|accessioned|acquired)\b")

# The tiers with their confidence, and how far from the front each kind is looked for (pages; characters where there are no pages).
CONFIDENCE = {"copyright line": 0.96, "publication line": 0.94, "covering letter": 0.82, "title page": 0.84, "annual report period": 0.76, "latest data year (lower bound)": 0.30}
FULL_FRONT, MONTH_FRONT, RANGE_PERIOD = 0.80, 0.77, 0.72
FRONT = {"publication": (4, 4_000), "copyright": (12, 12_000), "letter": (12, 12_000), "title": (12, 5_000), "annual": (20, 30_000)}
POOR_SCAN, POOR_CONFIDENCE = 0.5, 0.60


@dataclass(frozen=True)
class Label:
    """A label of a date: how far behind it a year may stand, and what may not, or must, stand between or after them."""

    pattern: re.Pattern
    reach: int
    not_between: re.Pattern
    between: re.Pattern
    not_after: re.Pattern | None = None


_MONTH_BETWEEN = rf"\b(?:{MONTH})\b"
PUBLISHED = Label(PUBLICATION, 100, re.compile(r"(?i)\b(?:results?|copies|report|material|data|article|notice|brochure|statistics?|figures?)\b"), re.compile(rf"(?is)^\s+by\s+authority\s+of\b|{_MONTH_BETWEEN}|^[\s,:;.-]*(?:(?:in|on|en)\s+)?$"), re.compile(_COPIES))
REVISED = Label(REVISION, 70, re.compile(r"(?i)^\s+(?:of|for)\b|\b(?:estimates?|results?|statistics?|data|reference\s+paper|catalogue|catalog|bibliography)\b"), re.compile(rf"(?is){_MONTH_BETWEEN}|^[\s,:;.-]*(?:(?:to|in|on)\s+)?$"), re.compile(_COPIES))
COPYRIGHTED = Label(COPYRIGHT, 120, re.compile(r"(?i)\b(?:published|material|report|article|notice)\b"), re.compile(rf"(?i)^[^A-Za-z]*$|\b(?:{_GOVERNMENT})\b"))


def no_date(line: str, m: re.Match) -> bool:
    """Whether a number that looks like a year is part of an identifier, a statute, a citation, an address, a quantity or a stamp."""
    low, (a, b), y = line.lower(), m.span("year"), m["year"]
    if DIGITAL.search(line) or LINE_IS_NONE.search(low) or re.search(rf"\b(?:act|regulation|statute)\s*,?\s*{y}\b|\br\.?s\.?o\.?\s*{y}\b|\([^)]{{0,60}},\s*{y}\s*\)", low):
        return True
    return bool(BEFORE_ID.search(low[max(0, a - 80) : a]) or AFTER_QUANTITY.match(low[b : b + 45]))


class Page:
    """The lines of a page with their places in it and in the whole text."""

    def __init__(self, text: str, number: int | None, base: int):
        self.text, self.number, self.base = text, number, base
        self.lines, self.at = [], []
        place = 0
        for chunk in text.splitlines(keepends=True):
            self.lines.append(chunk.rstrip("\r\n"))
            self.at.append(place)
            place += len(chunk)

    def near(self, i: int, before: int, after: int = 0) -> str:
        """The text of some lines around line i, as it is on the page."""
        a, b = max(0, i - before), min(len(self.lines) - 1, i + after)
        return self.text[self.at[a] : self.at[b] + len(self.lines[b])].strip()

    def front(self, i: int, kind: str) -> bool:
        pages, chars = FRONT[kind]
        return self.number <= pages if self.number is not None else self.base + self.at[i] <= chars

    def years(self, i: int) -> list[re.Match]:
        return [*YEAR.finditer(self.lines[i])]


def labelled(line: str, label: Label) -> list[re.Match]:
    """Years that a label on the line belongs to."""
    m = label.pattern.search(line)
    if not m:
        return []
    free = bool(IMPRINT.search(m.group()))
    out = []
    for y in YEAR.finditer(line):
        between, after = line[m.end() : y.start()], line[y.end() :]
        if y.start() < m.end() or len(between) > label.reach or label.not_between.search(between) or (label.not_after and label.not_after.match(after)):
            continue
        if free or label.between.search(between):
            out.append(y)
    return out


def _copyright(page: Page, i: int) -> list[re.Match]:
    line = page.lines[i]
    if not page.front(i, "copyright") or re.search(r"(?i)\bcopyright\s+(?:act|provisions?|restrictions?)\b", line):
        return []
    word = COPYRIGHT.search(line)
    found = labelled(line, COPYRIGHTED) if word and word.start() <= 30 else []
    at, years = line.find("©"), page.years(i)
    if found or at < 0 or line[:at].strip(" \t.,;:()[]{}*-_") or not years:
        return found
    between, after = line[at + 1 : years[0].start()], line[years[0].end() :]
    owner = re.compile(rf"(?i)\b(?:{_GOVERNMENT})\b")
    near = len(between) < 60 and not re.match(r"(?i)['’]s\b", after)
    mine = not re.search("[A-Za-z]", between) or owner.search(between)
    return years[:1] if near and mine and (owner.search(between + after) or page.base + page.at[i] <= 4_000) else []


def _revision(page: Page, i: int) -> list[re.Match]:
    line, rest = page.lines[i], len(page.text) - page.at[i]
    closing = page.number is None and rest <= min(1_500, max(300, int(len(page.text) * 0.10)))
    if re.search(r"(?i)^\s*revised\s+(?:statutes?|regulations?|act)\b", line) or not (page.front(i, "publication") or closing) or FORM.search(page.near(i, 8, 8)):
        return []
    return labelled(line, REVISED)


def stated(page: Page) -> Iterator[tuple]:
    """Tier 1: copyright, revision and publication lines."""
    for i, line in enumerate(page.lines):
        if not 0 < len(line.strip()) <= 280 or not page.years(i) or DIGITAL.search(line) or LINE_IS_NONE.search(line.lower()) or CITED.search(page.near(i, 3)):
            continue
        for basis, find, revision in (("copyright line", _copyright, False), ("publication line", _revision, True), ("publication line", lambda p, k: labelled(p.lines[k], PUBLISHED) if p.front(k, "publication") else [], False)):
            years = find(page, i)
            if years:
                yield from ((i, y, 1, basis, CONFIDENCE[basis], line.strip(), (), revision) for y in years)
                break


def _alone(line: str, m: re.Match) -> bool:
    """Whether a date is a dateline or title date and not part of a sentence."""
    before, after = line[: m.start()].strip(), line[m.end() :].strip()
    if after and not re.fullmatch(r"[.,;:()\[\]-]+", after):
        return False
    if len(before) <= 24 and not re.search(r"(?i)\b(?:in|during|since|from)\s*$", before):
        return True
    letters = [c for c in before if c.isalpha()]
    return bool(re.match(r"(?i)(?:no\.?|number|issue|bulletin|ottawa|toronto|montreal|quebec|ontario|canada)\b", before)) or bool(letters) and sum(map(str.isupper, letters)) >= 0.8 * len(letters)


def letters(page: Page) -> Iterator[tuple]:
    """Tier 2: the date of a letter that names an addressee and hands something over."""
    for i, line in enumerate(page.lines):
        dates = [m for m in FULL_DATE.finditer(line) if _alone(line, m)] if page.front(i, "letter") else []
        if not dates or BALANCE.search(line):
            continue
        around = page.near(i, 8, 22)
        if not (ADDRESSEE.search(around) and TRANSMITTAL.search(around)):
            continue
        span = range(max(0, i - 8), min(len(page.lines), i + 23))
        periods = {int(y["year"]) for k in span if ANNUAL.search(page.lines[k]) or re.search(r"(?i)\b(?:fiscal|calendar)\s+year\b", page.lines[k]) for y in page.years(k)}
        for d in dates:
            y = next((y for y in page.years(i) if y.start() >= d.start()), None)
            if y:
                yield i, y, 2, "covering letter", CONFIDENCE["covering letter"], around, tuple(sorted(periods - {int(y["year"])})), False


def front_dates(page: Page) -> Iterator[tuple]:
    """Tier 3: a date by itself on the front pages of what is no record of a meeting."""
    if not page.lines or EVENT_RECORD.search(page.near(0, 0, 80)):
        return
    for i, line in enumerate(page.lines):
        if not page.front(i, "title") or not 0 < len(line.strip()) <= 180:
            continue
        other = (re.compile(r"(?i)\bcopyright\b|\bcopr\.?\b|©|droits?\s+d['’]auteur"), PUBLICATION, REVISION, ANNUAL, BALANCE, DIGITAL, re.compile(r"(?i)\b(?:received|accessioned|library\s+stamp)\b"), WEEKDAY, RANGE)
        if any(p.search(line) for p in other) or STAMP.fullmatch(line) or len(MONTH_YEAR.findall(line)) > 1:
            continue
        whole, by_month = [*FULL_DATE.finditer(line)], [*MONTH_YEAR.finditer(line)]
        only = ONLY_YEAR.match(line) if page.number is not None else None
        dates = whole or by_month or ([only] if only else [])
        dates = [m for m in dates if not re.search(r"(?i)\b(?:passed|ending|ended|approved|adopted|dated)\b", line[: m.start()]) and _alone(line, m)]
        if not dates or NOT_FRONT.search(page.near(i, 8, 8)) or OTHER_DATE.search(page.near(i, 3)) or CITED.search(page.near(i, 3)):
            continue
        basis = "title page" if page.number is not None else "front matter date"
        sure = CONFIDENCE["title page"] if page.number is not None else FULL_FRONT if whole else MONTH_FRONT
        for d in dates:
            y = next((y for y in page.years(i) if d.start() <= y.start() < d.end()), None)
            if y:
                yield i, y, 3, basis, sure, line.strip(), (), False


def _period(line: str) -> tuple[int, int] | None:
    """Where a heading that states a reporting period stands on its line."""
    title, report, ended = PERIOD_TITLE.search(line), re.search(r"(?i)\b(?:annual\s+report|rapport\s+annuel)\b", line), PERIOD_ENDED.search(line)
    if title and not re.match(r"(?i)^\s*\d{4}\s+report\s+on\b", line):
        return title.span()
    if report:
        ahead = line[: report.start()]
        cites = re.search(r"(?i)\b(?:copies?|discussion|review|summary|index|catalogue|available|requested|mentions?|cites?|concerning|respecting|examination|according|supplements?|previous|prior)\b", ahead)
        return None if report.start() > 80 or cites or CITED.search(ahead) else report.span()
    return ended.span() if ended else None


def periods(page: Page) -> Iterator[tuple]:
    """Tier 4: the year of an annual report; a range gives its end."""
    if not page.lines or EVENT_RECORD.search(page.near(0, 0, 80)):
        return
    for i, line in enumerate(page.lines):
        span = _period(line) if page.front(i, "annual") and len(line.strip()) <= 320 else None
        if not span or CITED.search(page.near(i, 3)):
            continue
        years = [y for y in page.years(i) if span[0] - 18 <= y.start() <= span[1] + 140]
        ranges = [*RANGE.finditer(line)] if years else []
        for r in ranges:
            ends = sorted((int(r["first"]), int(r["last"])))
            y = next(y for y in page.years(i) if int(y["year"]) == ends[1])
            yield i, y, 4, "annual report period", RANGE_PERIOD, line.strip(), (ends[0],), False
        if not ranges:
            yield from ((i, y, 4, "annual report period", CONFIDENCE["annual report period"], line.strip(), (), False) for y in years)


def _row_years(line: str) -> list[re.Match]:
    """Years of a line that is a row of a table."""
    years = [y for y in YEAR.finditer(line) if not no_date(line, y)]
    if not years or len(re.findall("[A-Za-z]{2,}", line)) > 10 or re.search(r"[.!?](?:\s|$)", line):
        return []
    spaced = "|" in line or re.search(r"\s{2,}", line)
    leads = years[0].start() <= len(line) - len(line.lstrip(" |()[]")) + 2
    several = len({y["year"] for y in years}) > 1
    return years if leads or (spaced and (several or (len(NUMBER.findall(line)) >= 2 and "," not in line))) else []


def table_bounds(page: Page) -> Iterator[tuple]:
    """Tier 5: the latest year of a table of measured data, no publication can be earlier."""
    for i, line in enumerate(page.lines):
        if not TABLE.search(line) or CONTENTS.search(line) or FUTURE.search(page.near(i, 8, 17)):
            continue
        rows = {k: _row_years(page.lines[k]) for k in range(i, min(len(page.lines), i + 18))}
        found = [(int(y["year"]), k, y) for k, years in rows.items() for y in years]
        numeric = sum(bool(years) and len(NUMBER.findall(page.lines[k])) >= 2 for k, years in rows.items())
        across = any(len({y["year"] for y in years}) >= 3 for years in rows.values())
        if len({f[0] for f in found}) >= 3 and (numeric >= 3 or across):
            _, k, y = max(found, key=lambda f: (f[0], f[1], f[2].start()))
            basis = "latest data year (lower bound)"
            yield k, y, 5, basis, CONFIDENCE[basis], page.lines[k].strip(), (), False


def candidates(text: str | None, number: int | None = None, base: int = 0) -> list[dict]:
    """Candidates of a page: year, tier, basis, confidence, evidence, offset, alternatives, revision."""
    page = Page(text or "", number, base)
    out = []
    for rule in (stated, letters, front_dates, periods, table_bounds):
        for i, y, tier, basis, sure, evidence, others, revision in rule(page):
            if not no_date(page.lines[i], y):
                out.append({"year": int(y["year"]), "tier": tier, "basis": basis, "confidence": sure, "evidence": evidence, "offset": base + page.at[i] + y.start("year"), "others": list(others), "revision": revision})
    return out


CANDIDATE = "identifier string, year int, tier int, basis string, confidence double, evidence string, offset long, others array<int>, revision boolean, ocr double"


def date_candidates(pages: DataFrame) -> DataFrame:
    """CANDIDATE rows of pages (identifier, page, text, and ocr_confidence if known).

    A document of one row is a text without pages, whose front is told by characters.
    """
    own = Window.partitionBy("identifier")
    ocr = F.col("ocr_confidence").cast("double") if "ocr_confidence" in pages.columns else F.lit(None).cast("double")
    x = pages.select(F.col("identifier").cast("string").alias("identifier"), "page", F.coalesce("text", F.lit("")).alias("text"), ocr.alias("ocr"))
    x = x.withColumn("pages", F.count("*").over(own)).withColumn("before", F.coalesce(F.sum(F.when(F.col("text") != "", F.length("text") + 1)).over(own.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def run(frames):
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                number = None if r.pages == 1 else 10_000 if pd.isna(r.page) else int(r.page)
                rows += [{"identifier": r.identifier, **c, "ocr": r.ocr} for c in candidates(r.text, number, int(r.before))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CANDIDATE.split(", ")])

    return x.where("text <> ''").mapInPandas(run, CANDIDATE)


def resolve_dates(found: DataFrame) -> DataFrame:
    """(identifier, year, confidence, basis, evidence, alternatives) of CANDIDATE rows.

    The best tier decides.  Different years in it conflict, but for one revision later
    than all else, and for tables, whose latest year counts.  A later year in a table,
    or an annual period over a year away from a front date, conflicts too.
    """
    x = found.groupBy("identifier", "year", "tier", "basis", "evidence", "offset").agg(F.max("confidence").alias("confidence"), F.first("others").alias("others"), F.max("revision").alias("revision"), F.max("ocr").alias("ocr"))
    one = F.struct("tier", "offset", "year", "basis", "confidence", "evidence", "others", "revision", "ocr")
    x = x.groupBy("identifier").agg(F.sort_array(F.collect_list(one)).alias("all"))
    top = F.filter("all", lambda c: c["tier"] == F.get(F.col("all"), F.lit(0))["tier"])
    x = x.withColumn("top", top).withColumn("tier", F.get("top", F.lit(0))["tier"]).withColumn("years", F.array_distinct(F.transform("top", lambda c: c["year"])))
    best = lambda list_, *by: F.element_at(F.array_sort(F.transform(list_, lambda c: F.struct(*(b(c).alias(f"k{i}") for i, b in enumerate(by)), c.alias("c")))), -1)["c"]
    revised = F.filter("top", lambda c: c["revision"])
    latest = F.when((F.size(revised) == 1) & (F.get(revised, F.lit(0))["year"] == F.array_max("years")), F.get(revised, F.lit(0)))
    sure = best(F.col("top"), lambda c: c["confidence"], lambda c: -c["offset"])
    bound = best(F.col("top"), lambda c: c["year"], lambda c: -c["offset"])
    chosen = F.when(F.size("years") == 1, sure).when(F.col("tier") == 5, bound).when(F.col("tier") == 1, latest)
    x = x.withColumn("chosen", chosen)
    year = F.col("chosen.year")
    later = F.exists("all", lambda c: (c["tier"] == 5) & (c["year"] > year))
    apart = F.exists("all", lambda c: (c["tier"] == 4) & (F.abs(c["year"] - year) > 1))
    clash = F.col("chosen").isNull() | ((F.col("tier") < 5) & later) | ((F.col("tier") == 3) & apart)
    x = x.withColumn("clash", F.coalesce(clash, F.lit(True)))
    agree = F.size(F.array_distinct(F.transform(F.filter("all", lambda c: (c["year"] == year) & (c["basis"] != F.col("chosen.basis"))), lambda c: c["basis"])))
    confidence = F.least(F.lit(0.99), F.col("chosen.confidence") + F.lit(0.01) * agree)
    confidence = F.round(F.when(F.col("chosen.ocr") < POOR_SCAN, F.least(confidence, F.lit(POOR_CONFIDENCE))).otherwise(confidence), 4)
    every = F.flatten(F.transform("all", lambda c: F.concat(c["others"], F.array(c["year"]))))
    every = F.array_distinct(F.when(F.col("clash"), every).otherwise(F.concat(F.col("chosen.others"), every)))
    told = ~F.col("clash")
    return x.select(
        "identifier",
        F.when(told, year).alias("year"),
        F.when(told, confidence).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(told, F.col("chosen.basis")).otherwise("conflicting evidence").alias("basis"),
        F.when(told, F.col("chosen.evidence")).otherwise("").alias("evidence"),
        F.filter(every, lambda y: F.col("clash") | (y != year)).alias("alternatives"),
    )


def date_documents(pages: DataFrame) -> DataFrame:
    """One row a document of pages (identifier, page, text): resolve_dates(), or that there is no date to defend."""
    every = pages.select(F.col("identifier").cast("string").alias("identifier")).distinct()
    x = every.join(resolve_dates(date_candidates(pages)), "identifier", "left")
    return x.withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).withColumn("basis", F.coalesce("basis", F.lit("no defensible date"))).withColumn("evidence", F.coalesce("evidence", F.lit(""))).withColumn("alternatives", F.coalesce("alternatives", F.array().cast("array<int>")))
