"""Numbers written in words, English and French.

Words are folded to (value, scale) atoms first, compounds such as quatre-vingt-dix
included; a run of atoms is then summed scale by scale.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Number words, scales, words passed over, halves, qualifiers, unit words.
UNITS = {
    "zero": 0, "zéro": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fourty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
    "un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9, "dix": 10,
    "onze": 11, "douze": 12, "treize": 13, "quatorze": 14, "quinze": 15, "seize": 16,
    "vingt": 20, "vingts": 20, "trente": 30, "quarante": 40, "cinquante": 50, "soixante": 60,
}
SCALES = {
    "hundred": 100, "hundreds": 100, "cent": 100, "cents": 100, "thousand": 1000, "thousands": 1000, "mille": 1000, "milles": 1000,
    "million": 10**6, "millions": 10**6, "billion": 10**9, "billions": 10**9, "milliard": 10**9, "milliards": 10**9,
}
GLUE = frozenset(("and", "et", "a", "an", "of", "de", "des", "du"))
HALF = frozenset(("half", "demi", "demie"))
QUALIFIERS = {
    "just over": "over", "slightly over": "over", "a little over": "over", "well over": "over", "more than": "over", "over": "over", "in excess of": "over", "plus de": "over",
    "just under": "under", "slightly under": "under", "less than": "under", "under": "under", "nearly": "under", "almost": "under", "pres de": "under", "moins de": "under",
    "close to": "approximate", "about": "approximate", "approximately": "approximate", "some": "approximate", "around": "approximate", "roughly": "approximate", "environ": "approximate",
    "an average of": "average",
}
UNIT_AFTER = re.compile(
    r"\s*(?:gallons?|litres?|liters?|feet|foot|inches|inch|miles?|acres?|yards?|tons?|tonnes?|pounds?|lbs?|kilograms?|kg|grams?|degrees?|per\s?cent|percent|%"
    r"|hours?|days?|weeks?|months?|years?|people|persons|residents|inhabitants|households?|dwellings?|families|farms?|schools?|beds?|cases?|samples?"
    r"|cubic|square|million|thousand|pieds?|livres?|personnes|habitants|annees?|jours?)\b",
    re.I,
)

_WORD = re.compile(r"[A-Za-zÀ-ſ]+")
_QUALIFIER = re.compile("(" + "|".join(sorted(map(re.escape, QUALIFIERS), key=len, reverse=True)) + r")\s*$", re.I)


@dataclass(frozen=True)
class Atom:
    """A number word or compound of a text: kind is unit, scale, half, glue or other."""

    kind: str
    value: float
    start: int
    end: int


def atoms(text: str) -> list[Atom]:
    """Atoms of a text; French seventies to nineties are folded into one."""
    words, out, i = [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)], [], 0
    near = lambda k: k < len(words) and not text[words[k - 1][2] : words[k][1]].strip(" \t\n-")
    while i < len(words):
        w, s, e = words[i]
        if w == "quatre" and near(i + 1) and words[i + 1][0] in ("vingt", "vingts"):
            more = near(i + 2) and words[i + 2][0] == "dix"
            last = i + 1 + more
            out.append(Atom("unit", 90 if more else 80, s, words[last][2]))
        elif w == "soixante" and near(i + 1) and words[i + 1][0] == "dix":
            last = i + 1
            out.append(Atom("unit", 70, s, words[last][2]))
        else:
            last = i
            kind = "unit" if w in UNITS else "scale" if w in SCALES else "half" if w in HALF else "glue" if w in GLUE else "other"
            out.append(Atom(kind, UNITS.get(w, SCALES.get(w, 0)), s, e))
        i = last + 1
    return out


def _below_thousand(part: list[Atom]) -> tuple[float, bool, bool]:
    """Sum of units and hundreds, whether a half is among them, and whether there was any word."""
    total = 0.0
    for a in part:
        total = (total or 1.0) * 100 if a.kind == "scale" else total + a.value
    return total, any(a.kind == "half" for a in part), bool(part)


def _sum(run: list[Atom]) -> float | None:
    """Value of a run, scale by scale: a half goes to the next scale, or to the last one if nothing else follows it."""
    run = [a for a in run if a.kind != "glue"]
    if not run:
        return None
    total, last, part = 0.0, 0.0, []
    for a in run:
        if a.kind == "scale" and a.value > 100:
            n, half, any_ = _below_thousand(part)
            total += ((n + 0.5 if half else n) if any_ and (n or half) else 1.0) * a.value
            last, part = a.value, []
        else:
            part.append(a)
    n, half, _ = _below_thousand(part)
    total += n + (0.5 * last if half and not n and last else 0.5 if half else 0.0)
    return total


def words_to_number(phrase: str | None) -> float | None:
    """Value of the number that a phrase begins with, null if it begins with none."""
    found = []
    for a in atoms(phrase or ""):
        if a.kind == "other":
            break
        found.append(a)
    value = _sum(found)
    zero = any(a.kind == "unit" and a.value == 0 for a in found)
    return value if value or (value is not None and zero) else None


def _measures(value: float, magnitude: bool, trailing: str) -> bool:
    """A magnitude word, 20 or more, or a unit right after: numbers that nobody writes as an article."""
    return magnitude or value >= 20 or bool(UNIT_AFTER.match(trailing))


def scan(text: str | None) -> list[dict]:
    """The longest runs of number words: start, end, value, approximate, qualifier, magnitude, quantity."""
    text, out, run = text or "", [], []

    def close():
        while run and run[-1].kind == "glue":
            run.pop()
        value = _sum(run)
        if value or (run and any(a.kind == "unit" for a in run)):
            a, b = run[0].start, run[-1].end
            told = _QUALIFIER.search(text[max(0, a - 24) : a])
            qualifier = QUALIFIERS[told.group(1).lower()] if told else None
            magnitude = any(x.kind == "scale" for x in run)
            out.append({"start": a, "end": b, "value": value, "approximate": qualifier is not None, "qualifier": qualifier, "magnitude": magnitude, "quantity": _measures(value, magnitude, text[b : b + 40])})
        run.clear()

    for a in atoms(text):
        if a.kind == "other":
            close()
        elif run or a.kind != "glue":
            run.append(a)
    close()
    return out


def states_value(text: str | None, value: float, rel: float = 0.02) -> dict | None:
    """The first quantity in words that is the value, or within a share of it as a rounding."""
    for n in scan(text):
        if n["quantity"] and abs(n["value"] - value) <= rel * max(abs(n["value"]), abs(value)):
            return n
    return None


NUMERAL = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("value", "double").add("approximate", "boolean").add("qualifier", "string").add("magnitude", "boolean").add("quantity", "boolean"))


def _scan(text: pd.Series) -> pd.Series:
    return text.map(scan)


def _value(phrase: pd.Series) -> pd.Series:
    return phrase.map(lambda p: words_to_number(p) if p else None)


def numerals(text) -> Column:
    """Array of the spelled numbers of a text."""
    return F.pandas_udf(_scan, NUMERAL)(text)


def spelled_value(phrase) -> Column:
    """Value of the number a phrase begins with, else null."""
    return F.pandas_udf(_value, "double")(phrase)
