"""Quoted sentences and values against the text of a page: the exact rules, for one page at a time.

Column forms of the tokens are in text.py; these serve where the exact span on the
page is wanted.  A page is tokenised once for all quotes that cite it.
"""

from __future__ import annotations

import re
from decimal import Decimal
from functools import lru_cache

from ledgerline.functions import numerals

# The shape of a number, of meaning-bearing signs and words, of a table citation; letters that stand for digits.
NUMBER = r"(?<![\w.])[+\-−]?(?:\d{1,3}(?:,\s*\d{3})+(?:\.\s*\d+)?|\d+\.\s*\d+|\.\s*\d+|\d+)(?!\w|\.\s*\d)"
TOKEN = re.compile(rf"(?P<semantic>\+/-|<=|>=|[<>≤≥±%=£$€])|(?P<number>{NUMBER})|(?P<word>[^\W\d_]+(?:[’'][^\W\d_]+)?)")
CELL = re.compile(r"table\s+cell\s*\[\s*(.+?)\s*\]\s*$", re.I)
SCALED = re.compile(rf"({NUMBER})(?:\s*(thousand|million|billion)s?\b)?", re.I)
SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9}
LETTERS = str.maketrans({"I": "1", "l": "1", "|": "1", "O": "0"})
DIGIT_RUN = re.compile(r"[0-9IlO|]*[0-9][0-9IlO|]*")
SIGNS = {"≤": "<=", "≥": ">=", "+/-": "±"}
LEAST_TOKENS = 4


def _number(raw: str) -> str:
    n = re.sub(r"[\s,]", "", raw).replace("−", "-")
    plain = format(Decimal(n).normalize(), "f")
    return ("+" if n[0] == "+" and plain[0] != "-" else "") + ("0" if plain == "-0" else plain)


@lru_cache(maxsize=64)
def tokens(text: str) -> tuple[tuple[str, int, int], ...]:
    """(token, start, end): signs, canonical numbers, words."""
    name = {"semantic": lambda x: SIGNS.get(x, x), "number": _number, "word": lambda x: x.casefold().replace("’", "'")}
    return tuple((f"{m.lastgroup}:{name[m.lastgroup](m.group())}", m.start(), m.end()) for m in TOKEN.finditer(text or ""))


@lru_cache(maxsize=16)
def _places(text: str) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, (t, _, _) in enumerate(tokens(text)):
        out.setdefault(t, []).append(i)
    return out


def find_span(quote: str, page: str) -> str | None:
    """The characters of the page that hold the quote's tokens in a row, unless a sign stands right beside them."""
    wanted, have = [t for t, _, _ in tokens(quote)], tokens(page)
    if not wanted:
        return None
    places = _places(page)
    # start from the token that is rarest on the page
    k = min(range(len(wanted)), key=lambda i: len(places.get(wanted[i], ())))

    def sign(i: int, a: int, b: int) -> bool:
        return 0 <= i < len(have) and have[i][0].startswith("semantic:") and not page[a:b].strip()

    for at in places.get(wanted[k], ()):
        a, b = at - k, at - k + len(wanted)
        if a < 0 or b > len(have) or any(have[a + i][0] != w for i, w in enumerate(wanted)):
            continue
        if sign(a - 1, have[a - 1][2], have[a][1]) or (b < len(have) and sign(b, have[b - 1][2], have[b][1])):
            continue
        tail = re.compile("[.,;:!?]*").match(page, have[b - 1][2])
        return page[have[a][1] : tail.end()]
    return None


def holds_run(part: str | None, whole: str | None) -> bool:
    """Whether the tokens of part stand in a row among those of whole."""
    p, w = ("\x1f" + "".join(t + "\x1f" for t, _, _ in tokens(x or "")) for x in (part, whole))
    return len(p) > 1 and p in w


def repaired(text: str) -> str:
    """Letters that a scan took for digits, inside runs that hold a digit."""
    return DIGIT_RUN.sub(lambda m: m.group().translate(LETTERS), text)


def numbers(text: str) -> set[float]:
    """The numbers that a text states, those before thousand, million, billion scaled as well."""
    out = set()
    for m in SCALED.finditer(text):
        n = float(re.sub(r"[\s,]", "", m.group(1)).replace("−", "-"))
        out |= {n, n * SCALES[m.group(2).lower()]} if m.group(2) else {n}
    return out


def value_in_quote(value: float | None, quote: str) -> tuple[str, str]:
    """(ok, unchecked or failed; why): whether a sentence states the value that is said to be read from it."""
    if value is None:
        return "unchecked", "no value to check"
    digits = re.sub("[^0-9]", "", repaired(quote))
    if digits:
        plain = repr(float(value)).removesuffix(".0")
        if re.search(rf"(?<![\d.+-]){re.escape(plain)}(?![\d.])", re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", quote)):
            return "ok", ""
        for text, how in ((quote, "reading the sentence's numbers as numbers, not as digits"), (repaired(quote), "once OCR letter-for-digit damage is undone")):
            if float(value) in numbers(text):
                return "ok", how
    said = numerals.states_value(quote, float(value))
    if said:
        return "ok", f"the sentence states it in words ({quote[said['start'] : said['end']]!r})"
    if not digits:
        return "failed", f"the sentence states no number, in digits or in words, so it cannot be where {value} came from"
    return "failed", f"the value {value} does not appear in the sentence it cites (sentence digits: {digits[:40]})"


def label_on_page(label: str, page: str) -> bool:
    """Whether a table heading is on the page: as a whole, else all its long words, else all its words."""
    fold = lambda x: re.sub("[^a-z0-9]+", "", x.lower())
    text = fold(page)
    if not text or (fold(label) and fold(label) in text):
        return True
    words = [w for w in re.split(r"\W+", label.lower()) if w]
    asked = [w for w in words if len(w) >= 4] or words
    return bool(asked) and all(fold(w) in text for w in asked)


def can_referee(labels: list[str], page: str) -> bool:
    """Whether the page shows that its scan can be read: one of the headings is on it."""
    return bool(page.strip()) and any(x.strip() and label_on_page(x, page) for x in labels)


def check_cell(labels: list[str], page: str) -> str:
    """Why a table citation is not taken: a heading cannot tie a number to a cell, so it always abstains."""
    if len(labels) < 2:
        return "table evidence must cite both a row heading and a column heading"
    if [t for t, _, _ in tokens(labels[0])] == [t for t, _, _ in tokens(labels[1])]:
        return "table row and column headings must identify two distinct dimensions"
    if not can_referee(labels, page):
        return "the page OCR cannot referee the cited table headings; evidence abstained"
    missing = [x for x in labels if not label_on_page(x, page)]
    if missing:
        return "the table headings cited are not on that page: " + ", ".join(map(repr, missing))
    return "the table headings are on the page, but the citation has no localized cell evidence; abstained"


def judge(quote: str, value: float | None, page: str | None) -> tuple[str, str, str | None]:
    """(state, why, the span on the page): verified, unchecked, unsupported or failed."""
    if not page:
        return "unsupported", "page not retrievable", None
    cell = CELL.match(quote.strip())
    if cell:
        return "failed", check_cell([p.strip() for p in cell.group(1).split("/") if p.strip()], page), None
    asked = tokens(quote)
    if not any(t.startswith("word:") for t, _, _ in asked):
        return "failed", "prose evidence must include textual context, not only a number", None
    span = find_span(quote, page)
    if span is None:
        return "failed", "quoted sentence is not on that page", None
    state, why = value_in_quote(value, span)
    if state == "unchecked" and len(asked) < LEAST_TOKENS:
        return "unsupported", "with no value to check, the sentence is the entire evidence, and one this short could be found anywhere", None
    return {"ok": "verified"}.get(state, state), why, span.strip() if state != "failed" else None
