"""Minutes: motions, recorded divisions, people, partnerships, dissent.

A page is read by fixed patterns in one Arrow batch function, which yields rows; all
that is asked of them afterwards is aggregation.  A division that belongs to no
motion on its page is kept as a motion without a mover.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Titles, patterns of motions, outcomes, rolls, dates and subjects, words that are no names, windows in characters.
TITLES = (
    "Deputy Mayor", "Acting Mayor", "Mayor", "Reeve", "Deputy Reeve", "Warden", "Alderman", "Aldermen", "Alderwoman", "Councillor", "Councilman", "Controller", "Chairman", "Chairwoman",
    "Chair", "Commissioner", "Trustee", "Treasurer", "Clerk", "Solicitor", "Engineer", "Hon.", "Mr.", "Mrs.", "Miss", "Ms.", "Dr.",
)
_TITLE = "|".join(map(re.escape, TITLES))
_SURNAME = r"(?-i:[A-Z][A-Za-z‘’'´`�.-]{1,24})"
_PERSON = rf"(?:(?:{_TITLE})\s+)?({_SURNAME}(?:\s+{_SURNAME})?)"
_OUTCOMES = "CARRIED|DEFEATED|LOST|WITHDRAWN|DEFERRED|TABLED"
_MOVED = r"(?:it\s+was\s+)?moved\s+by\s"
MOTION = re.compile(rf"{_MOVED}+{_PERSON}\s*,?\s*and\s+seconded\s+by\s+{_PERSON}\s*,?\s*(?:that\s+)?(.{{0,900}}?)(?=\b(?:{_OUTCOMES})\b|{_MOVED}|\Z)", re.I | re.S)
OUTCOME = re.compile(rf"\b({_OUTCOMES}|REFERRED BACK)\b", re.I)
NEXT = re.compile(_MOVED, re.I)
LABEL = re.compile(r"\b(YEAS?|NAYS?|ABSTAIN(?:ED|TIONS)?|ABSENT)\b\s*[:.]?", re.I)
STOP = re.compile(rf"\b({_OUTCOMES}|moved\s+by|Recorded\s+vote)\b", re.I)
TALLY = re.compile(r"[-—–]\s*(\d+)\s*[^A-Za-z0-9]{0,6}$")
DATE = re.compile(r"\b(1[6-9]\d\d|20[0-2]\d)\s+(January|February|March|April|May|June|July|August|September|October|November|December)\s+(\d{1,2})\b", re.I)
SUBJECT = re.compile(r"\bRe\s*:\s*(.{4,220}?)(?=\s*(?:Recorded vote|YEAS?\s*:|\Z))", re.I | re.S)
NO_NAMES = frozenset(
    ("the", "that", "this", "council", "committee", "report", "section", "city", "board", "motion", "resolution", "amendment", "and", "seconded", "moved", "his", "her", "worship", "same", "none", "nil", "carried", "defeated")
)
APOSTROPHES = str.maketrans(dict.fromkeys("‘’´`�", "'"))
ROLL_CHARS, OUTCOME_CHARS, GAP_CHARS, HEAD_CHARS, AFTER_CHARS = 400, 700, 40, 400, 200
NO_SUBJECT = "(recorded division, subject not stated on page)"

ROLL = "struct<cast:string,people:array<string>,stated:int>"
MOTION_ROW = f"seq int, mover string, seconder string, text string, outcome string, date string, quote string, rolls array<{ROLL}>"


def clean_name(raw: str | None) -> str:
    """Apostrophes, blanks and end marks put right; no spelling is guessed."""
    return re.sub(r"\s+", " ", (raw or "").translate(APOSTROPHES)).strip(" .,;:")


def plausible(name: str) -> bool:
    """Two letters at least, mostly letters, and no word of the minutes themselves."""
    t = clean_name(name)
    letters = sum(map(str.isalpha, t))
    return t.lower() not in NO_NAMES and letters >= 2 and letters >= 0.6 * len(t)


def names(blob: str) -> list[str]:
    """People of a roll: titles dropped, parted at commas, semicolons and ``and``."""
    parts = re.split(r"[,;]|\band\b", re.sub(rf"\b({_TITLE})\b", " ", blob, flags=re.I))
    return [clean_name(p) for p in parts if clean_name(p) and plausible(p)]


def _cast(label: str) -> str:
    t = label.lower()
    return "absent" if t == "absent" else t.rstrip("s") if t.rstrip("s") in ("yea", "nay") else "abstain"


def rolls(text: str) -> list[tuple[int, int, dict]]:
    """(start, end, roll) of each labelled list; a list ends at the next label, at an outcome, or after ROLL_CHARS."""
    marks = [*LABEL.finditer(text)]
    out = []
    for m, following in zip(marks, [*(x.start() for x in marks[1:]), len(text)], strict=False):
        end = min(following, m.end() + ROLL_CHARS)
        stop = STOP.search(text, m.end(), end)
        end = stop.start() if stop else end
        blob = text[m.end() : end].strip()
        tally = TALLY.search(blob)
        people = names(blob[: tally.start()] if tally else blob)
        out.append((m.start(), end, {"cast": _cast(m.group(1)), "people": people, "stated": int(tally.group(1)) if tally else None}))
    return out


def _motions(text: str) -> Iterator[tuple[int, dict, tuple[int, int]]]:
    """(start, motion, the stretch that its rolls take) of each motion that names two people."""
    for m in MOTION.finditer(text):
        if not (plausible(m[1]) and plausible(m[2])):
            continue
        after = text[m.end() : m.end() + OUTCOME_CHARS]
        other = NEXT.search(after)
        after = after[: other.start()] if other else after
        told = OUTCOME.search(after)
        window = after[: told.end()] if told else after
        found = [r for _, _, r in rolls(window)]
        end = m.end() + (told.end() if told else 0)
        row = {"mover": clean_name(m[1]), "seconder": clean_name(m[2]), "text": clean_name(m[3])[:900], "outcome": told[1].lower() if told else "unrecorded", "quote": text[m.start() : end][:1200], "rolls": found}
        yield m.start(), row, (m.end(), m.end() + len(window) if found else m.end())


def _divisions(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, dict]]:
    """Divisions outside motions: lists that follow each other closely are one."""
    groups: list[list[tuple[int, int, dict]]] = []
    for r in rolls(text):
        if any(a <= r[0] < b for a, b in taken):
            continue
        if groups and 0 <= r[0] - groups[-1][-1][1] <= GAP_CHARS:
            groups[-1].append(r)
        else:
            groups.append([r])
    for g in groups:
        start, end, _ = g[0]
        subjects = SUBJECT.findall(text[max(0, start - HEAD_CHARS) : start])
        told = OUTCOME.search(text[end : end + AFTER_CHARS])
        subject = clean_name(subjects[-1])[:400] if subjects else ""
        quote = text[max(0, start - 260) : end + 60][:1200]
        yield start, {"mover": "", "seconder": "", "text": subject or NO_SUBJECT, "outcome": told[1].lower() if told else "unrecorded", "quote": quote, "rolls": [r for _, _, r in g]}


def read_page(text: str | None) -> list[dict]:
    """Motions and divisions of a page in order: mover, seconder, text, outcome, date, quote, rolls."""
    text = " ".join((text or "").split())
    day = DATE.search(text)
    date = f"{day[1]}-{day[2][:3]}-{int(day[3]):02d}" if day else ""
    moved = [*_motions(text)]
    found = [(s, row) for s, row, _ in moved] + [*_divisions(text, [t for _, _, t in moved])]
    return [{**row, "date": date} for _, row in sorted(found, key=lambda x: x[0])]


def motions(pages: DataFrame, keys: list[str], text: str = "text", year: str | None = None) -> DataFrame:
    """keys and MOTION_ROW, one row a motion or division; a page without a date has its year."""
    types = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + MOTION_ROW
    fields = [x.split()[0] for x in MOTION_ROW.split(", ")[:7]] + ["rolls"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                for i, m in enumerate(read_page(r["_text"])):
                    m["date"] = m["date"] or r["_year"] or ""
                    rows.append([*(r[k] for k in keys), i, *(m[c] for c in fields[1:])])
            yield pd.DataFrame(rows, columns=[*keys, *fields])

    given = F.col(year).cast("string") if year else F.lit(None).cast("string")
    return pages.select(*keys, F.col(text).alias("_text"), given.alias("_year")).mapInPandas(run, schema)


def decided(found: DataFrame) -> DataFrame:
    """Motions that record a decision: with a mover and a seconder, or with a roll."""
    return found.where("(mover <> '' and seconder <> '') or size(rolls) > 0")


def votes(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seq, cast, person: one row a vote."""
    x = found.select(*keys, "seq", F.explode("rolls").alias("r"))
    return x.select(*keys, "seq", F.col("r.cast").alias("cast"), F.explode("r.people").alias("person"))


def _agrees(roll: Column) -> Column:
    return roll["stated"].isNull() | (roll["stated"] == F.size(roll["people"]))


def roll_checks(found: DataFrame) -> DataFrame:
    """One row: motions and divisions, those with rolls, whose names and tallies do not agree, with a tally to check, and without one."""
    has = F.size("rolls") > 0
    checkable = F.exists("rolls", lambda r: r["stated"].isNotNull())
    wrong = ~F.forall("rolls", _agrees)
    return decided(found).agg(
        F.count("*").alias("motions"),
        F.count_if(has).alias("recorded_votes"),
        F.count_if(has & wrong).alias("rolls_that_do_not_reconcile"),
        F.count_if(has & checkable).alias("rolls_checkable"),
        F.count_if(has & ~checkable).alias("rolls_with_no_tally"),
    )


def outcomes(found: DataFrame) -> DataFrame:
    return decided(found).groupBy("outcome").agg(F.count("*").alias("n"))


def partnerships(pairs: DataFrame, a: str, b: str, limit: int = 20) -> DataFrame:
    """Who seconds whom, most often first."""
    x = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != "") & (F.col(b) != "")).groupBy(F.lower(a).alias("mover"), F.lower(b).alias("seconder")).agg(F.count("*").alias("n"))
    return x.orderBy(F.desc("n"), "mover", "seconder").limit(limit)


def _actions(found: DataFrame, document: str, body: str | None) -> DataFrame:
    """(person, action, date, document, body): each motion's mover, seconder and votes."""
    body = F.col(body) if body else F.lit("")
    x = decided(found).select(F.col(document).alias("document"), body.alias("body"), "date", "mover", "seconder", "rolls")
    named = lambda who, what: F.struct(F.col(who).alias("person"), F.lit(what).alias("action"))
    cast = F.flatten(F.transform("rolls", lambda r: F.transform(r["people"], lambda p: F.struct(p.alias("person"), r["cast"].alias("action")))))
    x = x.select("document", "body", "date", F.explode(F.concat(F.array(named("mover", "moved"), named("seconder", "seconded")), cast)).alias("a"))
    return x.select("a.person", "a.action", "date", "document", "body").where("person <> ''")


ACTIONS = ("moved", "seconded", "yea", "nay", "abstain", "absent")


def people(found: DataFrame, document: str, body: str | None = None) -> DataFrame:
    """One row a person: counts of each action, appearances, bodies, documents, first and last seen; spellings are not merged."""
    x = _actions(found, document, body).groupBy(F.lower("person").alias("person"))
    dated, in_body = F.when(F.col("date") != "", F.col("date")), F.when(F.col("body") != "", F.col("body"))
    return x.agg(*(F.count_if(F.col("action") == a).alias(a) for a in ACTIONS), F.count("*").alias("appearances"), F.sort_array(F.collect_set(in_body)).alias("bodies"), F.sort_array(F.collect_set("document")).alias("documents"), F.min(dated).alias("first_seen"), F.max(dated).alias("last_seen"))


def most_active(ledger: DataFrame, limit: int = 20) -> DataFrame:
    return ledger.orderBy(F.desc("appearances"), "person").limit(limit)


def dissenters(ledger: DataFrame, limit: int = 15) -> DataFrame:
    """Who voted no, most often first."""
    return ledger.where("nay > 0").select("person", F.col("nay").alias("nays"), F.col("yea").alias("yeas")).orderBy(F.desc("nays"), "person").limit(limit)


def divided(found: DataFrame, keys: list[str], limit: int = 15) -> DataFrame:
    """Recorded votes with somebody against, in order of place: keys, seq, text, outcome, against, date."""
    against = F.flatten(F.transform(F.filter("rolls", lambda r: r["cast"] == "nay"), lambda r: r["people"]))
    x = found.select(*keys, "seq", F.substring("text", 1, 200).alias("text"), "outcome", against.alias("against"), "date").where(F.size("against") > 0)
    return x.orderBy(*keys, "seq").limit(limit)


def titles(pages: DataFrame, text: str = "text") -> DataFrame:
    """(person, title, pages): titles that stand before a surname, counted once a page."""
    pattern = rf"(?i)\b((?:{'|'.join(x.replace('.', chr(92) + '.') for x in TITLES)})\s+(?-i:[A-Z][A-Za-z‘’'´`�.-]{{1,24}}))"
    x = pages.select(F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, r"\s+", " "), F.lit(pattern), F.lit(1)))).alias("t"))
    title = F.initcap(F.regexp_extract("t", rf"(?i)^({'|'.join(x.replace('.', chr(92) + '.') for x in TITLES)})", 1))
    person = F.btrim(F.regexp_replace(F.regexp_extract("t", r"(\S+)$", 1), "[‘’´`�]", "'"), F.lit(" .,;:"))
    x = x.select(F.lower(person).alias("person"), F.when(title == "Aldermen", "Alderman").otherwise(title).alias("title"))
    return x.where(~F.col("person").isin(*NO_NAMES) & (F.length("person") >= 2)).groupBy("person", "title").agg(F.count("*").alias("pages"))
