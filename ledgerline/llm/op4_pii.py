"""Personal data by rules and a semi-Markov conditional random field.

Base spans (email, ip, card, phone) follow fixed patterns and always stay.  The
field adds spans that the patterns miss: obfuscated addresses, telephone numbers
without a plus, cards with odd separators.  A candidate segment is scored by
features of the whole span (digit count, grouping, separators, Luhn, neighbours,
the word before it); segments are at most MAX_SPAN characters, and dynamic
programming over their boundaries picks the best set of non-overlapping typed
segments, with weights for one type following another.  Weights are trained by
conditional likelihood on base spans from a bounded sample of documents, on
rewritten copies of them, and on generated examples of what is no personal data.

Defined cases: null and empty texts have no span; patterns are matched in linear
time on texts of any length; repeated rows are each reported; further columns
are ignored.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

KINDS = ("email", "ip", "card", "phone")
MAX_SPAN, MAX_PIECES = 64, 8
#: The training sample: documents at most from which segments are taken, and segments at most; those with the smallest hashes.
FIT_DOCS, FIT_CLUSTERS = 8_000, 1_500
EPOCHS = 6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _emails(text: str):
    """Leftmost matches, found from each ``@``: the local part cannot hold one, so a match begins where its run does."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            free = host.end()
        # a run is walked once: the next one cannot reach behind this sign
        free = max(free, at + 1)
        at = text.find("@", free)


def _ips(text: str):
    at = 0
    while m := _IP.search(text, at):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()
        at = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed patterns, by kind and start; failing matches are dropped, not retried."""
    out = []
    if "@" in text:
        out += [(0, s, e) for s, e in _emails(text)]
    if re.search("[0-9]", text):
        out += [(1, s, e) for s, e in _ips(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if sum("0" <= c <= "9" for c in m[0]) in range(9, 16):
                    out.append((3, m.start(), m.end()))
    return out


# ---- candidate segments and their features ----

_NUMERIC = re.compile(r"(?<![0-9])[+(]{0,2}[0-9][0-9 ().\-/]{5,}(?<=[0-9])")
_AT = re.compile(
    r"[A-Za-z0-9._%+-]{1,40}(?:@|\x20?[(\[]at[)\]]\x20?|\x20at\x20)[A-Za-z0-9-]{1,30}(?:(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,30}){1,4}",
    re.IGNORECASE,
)
#: What every match of _AT holds.
_HINT = re.compile(r"@|[(\[]at[)\]]|\x20at\x20", re.IGNORECASE)
#: Words before a span that name its kind.
_NAMES = (("mail", "email", "contact", "write"), ("ip", "host", "server", "address"), ("card", "visa", "credit", "cc", "mastercard"), ("phone", "tel", "call", "fax", "mobile", "telephone"))
_SHAPES = ("3-3-4", "1-3-3-4", "4-4-4-4", "4-6-5", "2-2-2-2-2", "3-4", "2-3-3-4", "2-4-4", "4-2-2", "2-2-4")
N_FEATURES = 48


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of segments that may be an entity; no more than MAX_PIECES pieces of a numeric run each."""
    found: set[tuple[int, int, int]] = set()
    if _HINT.search(text):
        for m in _AT.finditer(text):
            if m.end() - m.start() <= MAX_SPAN:
                found.add((m.start(), m.end(), 0))
    if re.search("[0-9]", text):
        for m in _NUMERIC.finditer(text):
            pieces = [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer(r"[^ ]+", m[0])]
            for i, (s, _) in enumerate(pieces):
                digits = 0
                for a, b in pieces[i : i + MAX_PIECES]:
                    digits += sum("0" <= c <= "9" for c in text[a:b])
                    if digits > 19 or b - s > 40:
                        break
                    end = b
                    while end > a and not "0" <= text[end - 1] <= "9":
                        end -= 1
                    if digits >= 7 and end > a:
                        found |= {(s, end, k) for k in ((2, 3) if 12 <= digits <= 15 else (2,) if digits > 15 else (3,))}
                    if text.count(".", s, end) == 3 and a == s:
                        found.add((s, end, 1))
    return sorted(found, key=lambda c: (c[1], c[0], c[2]))


def features(text: str, start: int, end: int, kind: int) -> list[int]:
    """Numbers of the features that hold for the whole span."""
    span = text[start:end]
    before, after = text[start - 1 : start] if start else "", text[end : end + 1]
    on = [0]
    on.append(1 if before.isalnum() else 2 if before in ("=", ":", "#", "$", '"', "'", "/") and before else 3)
    on.append(4 if after.isalnum() else 5 if after in ("/", "%", "€", "$", '"', "'") and after else 6)
    word = re.search(r"([A-Za-z]+)\W{0,3}$", text[max(0, start - 24) : start])
    if word:
        on += [7 + k for k in range(4) if word[1].lower() in _NAMES[k] and k == kind]
    if kind == 0:
        low = span.lower()
        on.append(11 if "@" in span else 12 if re.search(r"[(\[]at[)\]]", low) else 13)
        on.append(14 if re.search(r"[(\[]dot[)\]]|\x20dot\x20", low) else 15)
        tail = re.split(r"[^a-z0-9-]+", low)[-1]
        if re.search(r"[0-9._+]", re.split(r"[@(\[\x20]", low)[0]):
            on.append(47)
        on.append(16 if tail.isalpha() and 2 <= len(tail) <= 6 else 17)
        return on
    digits = _digits(span)
    on.append(18 + min(12, max(0, len(digits) - 7)))
    on.append(31 if luhn(digits) else 32)
    groups = "-".join(str(len(g)) for g in re.findall("[0-9]+", span))
    on.append(33 + _SHAPES.index(groups) if groups in _SHAPES else 43)
    if "+" in span:
        on.append(44)
    if "(" in span or ")" in span:
        on.append(45 if span.count("(") == span.count(")") else 46)
    if "/" in span or len(set(re.findall(r"[^0-9()+]", span))) > 2:
        on.append(47)
    return on


def clusters(text: str) -> list[list[tuple[int, int, int]]]:
    """Candidates grouped so that those of two groups never overlap."""
    groups, reach = [], -1
    for c in sorted(candidates(text)):
        if c[0] >= reach:
            groups.append([])
        groups[-1].append(c)
        reach = max(reach, c[1])
    return [sorted(g, key=lambda c: (c[1], c[0], c[2])) for g in groups]


class Field:
    """Weights by kind and feature, and of one kind after another (the last row: after none)."""

    def __init__(self):
        self.w = np.zeros((4, N_FEATURES))
        self.t = np.zeros((5, 4))

    def score(self, text: str, c: tuple[int, int, int]) -> float:
        return float(self.w[c[2], features(text, *c)].sum())

    def best(self, text: str, group: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The segmentation of highest score; states are (boundary, kind of the last segment)."""
        ends = sorted({c[1] for c in group})
        states: list[dict[int, tuple[float, tuple]]] = [{4: (0.0, ())}]
        i = 0
        for end in ends:  # the group is in order of its ends
            now = dict(states[-1])
            while i < len(group) and group[i][1] == end:
                c = group[i]
                own = self.score(text, c)
                for last, (value, path) in states[bisect_left(ends, c[0] + 1)].items():
                    v = value + own + self.t[last, c[2]]
                    if c[2] not in now or v > now[c[2]][0]:
                        now[c[2]] = (v, (path, c))
                i += 1
            states.append(now)
        path, out = max(states[-1].values(), key=lambda x: x[0])[1], []
        while path:
            out.append(path[1])
            path = path[0]
        return out[::-1]

    def expected(self, group, on) -> tuple[dict, np.ndarray]:
        """Probability of each candidate and expected transitions, by forward and backward sums."""
        ends = sorted({c[1] for c in group})
        n = len(ends)
        at = [bisect_left(ends, c[0] + 1) for c in group]
        to = [bisect_left(ends, c[1]) + 1 for c in group]
        s = [float(self.w[c[2], f].sum()) for c, f in zip(group, on, strict=True)]
        fwd, back = np.full((n + 1, 5), -np.inf), np.zeros((n + 1, 5))
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        starting: list[list[int]] = [[] for _ in range(n + 1)]
        for i in range(len(group)):
            ending[to[i]].append(i), starting[at[i]].append(i)
        fwd[0, 4] = 0
        for j in range(1, n + 1):
            fwd[j] = fwd[j - 1]
            for i in ending[j]:
                k = group[i][2]
                fwd[j, k] = np.logaddexp(fwd[j, k], np.logaddexp.reduce(fwd[at[i]] + self.t[:, k]) + s[i])
        for j in range(n - 1, -1, -1):
            back[j] = back[j + 1]
            for i in starting[j]:
                k = group[i][2]
                back[j] = np.logaddexp(back[j], self.t[:, k] + s[i] + back[to[i], k])
        z = np.logaddexp.reduce(fwd[n])
        p, moves = {}, np.zeros((5, 4))
        for i, c in enumerate(group):
            q = np.exp(np.clip(fwd[at[i]] + self.t[:, c[2]] + s[i] + back[to[i], c[2]] - z, -50, 0))
            p[i] = float(q.sum())
            moves[:, c[2]] += q
        return p, moves

    def fit(self, examples: list[tuple[str, set]], epochs: int = EPOCHS, seed: int = 5) -> Field:
        """examples: (text, true (start, end, kind)); Adagrad on the conditional likelihood."""
        data = []
        for text, gold in examples:
            for g in clusters(text):
                data.append((g, [features(text, *c) for c in g], [i for i, c in enumerate(g) if c in gold]))
        rng, gw, gt = random.Random(seed), np.full_like(self.w, 1e-2), np.full_like(self.t, 1e-2)
        for _ in range(epochs):
            rng.shuffle(data)
            for group, on, gold in data:
                p, moves = self.expected(group, on)
                dw, dt, last = np.zeros_like(self.w), -moves, 4
                for i, c in enumerate(group):
                    dw[c[2], on[i]] -= p[i]
                for i in gold:
                    dw[group[i][2], on[i]] += 1
                    dt[last, group[i][2]] += 1
                    last = group[i][2]
                dw -= 1e-3 * self.w
                dt -= 1e-3 * self.t
                gw += dw * dw
                gt += dt * dt
                self.w += 0.3 * dw / np.sqrt(gw)
                self.t += 0.3 * dt / np.sqrt(gt)
        return self


def _rewritten(text: str, kind: int, start: int, end: int, rng: random.Random):
    """A copy of a base span as the patterns would miss it, and where it then lies; None if there is none."""
    span = text[start:end]
    if kind == 0:
        name, host = span.split("@", 1)
        span = name + rng.choice((" at ", "(at)", " (at) ", "[at]", " [at] ")) + host.replace(".", rng.choice((" dot ", "(dot)", " [dot] ")))
    elif kind == 2:
        d = _digits(span)
        span = rng.choice((".", "-", " ")).join(d[i : i + 4] for i in range(0, len(d), 4)) if len(d) == 16 else d
    elif kind == 3:
        span = re.sub(r"^\+[0-9]{0,3}[ .-]?", "", span) if rng.random() < 0.7 else span[1:]
        if len(_digits(span)) < 9:
            return None
    else:
        return None
    return text[:start] + span + text[end:], {(start, start + len(span), kind)}


def generated(rng: random.Random, n: int = 150) -> list[tuple[str, set]]:
    """Examples that need no corpus: entities in their usual forms, and numbers that are none."""
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    words = ["and", "the", "for", "de", "und", "la", "in", "que", "mit", "was"]
    out = []
    for _ in range(n):
        d = "4" + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        entities = [
            (3, rng.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}"))),
            (2, rng.choice(("-", " ", ".", "")).join(d[i : i + 4] for i in range(0, 16, 4))),
            (0, f"{rng.choice('abcdefg')}{num(2)}{rng.choice((' at ', '(at)', ' [at] '))}mail{rng.choice((' dot ', '(dot)', ' [dot] '))}com"),
            (1, ".".join(str(rng.randrange(256)) for _ in range(4))),
        ]
        nothing = [
            f"{rng.randrange(1900, 2030)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}", f"{rng.randrange(10, 29)}.{rng.randrange(10, 13)}.{rng.randrange(1900, 2030)}",
            num(rng.randrange(7, 13)), f"{num(3)} {num(2)} {num(4)} {num(2)}", f"{num(2)}/{num(2)}/{num(4)}", d[:-1] + str((int(d[-1]) + 1 + rng.randrange(8)) % 10), f"{num(4)}-{num(4)}", f"{num(6)}.{num(4)}",
        ]
        for kind, e in entities:
            head = f"{rng.choice(words)} {rng.choice(words)} "
            out.append((f"{head}{e} {rng.choice(words)}", {(len(head), len(head) + len(e), kind)}))
        for e in nothing:
            out.append((f"{rng.choice(words)} {rng.choice(words)} {e} {rng.choice(words)}", set()))
        out.append((f"{rng.choice(words)} at {rng.choice(words)} dot {rng.choice(words)} and", set()))
    return out


def train(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_clusters: int = FIT_CLUSTERS) -> Field:
    """Field from ``fit_clusters`` segments at most of ``fit_docs`` at most of docs (doc_id, text), those with the smallest hashes."""
    ids = common.label_sample(docs.select("doc_id").where("doc_id is not null").distinct(), fit_docs)

    def run(batches):
        for b in batches:
            found = []
            for text in b.column(0).to_pylist():
                text = text or ""
                base = base_spans(text)
                near = [(text[max(0, s - 30) : e + 20], s - max(0, s - 30), e - max(0, s - 30), k) for k, s, e in base]
                taken = [(s, e) for _, s, e in base]
                for g in clusters(text):
                    s, e = g[0][0], max(c[1] for c in g)
                    if not any(a < e and s < z for a, z in taken):
                        near.append((text[max(0, s - 30) : e + 20], 0, 0, -1))
                found += near
            cols = list(zip(*found, strict=True)) if found else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int32()) for c in cols[1:])], names=["near", "s", "e", "kind"])

    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text").mapInArrow(run, "near string, s int, e int, kind int")
    rows = rows.orderBy(F.xxhash64("near", "kind"), "near", "s").limit(fit_clusters).collect()
    rng = random.Random(11)
    examples = generated(rng)
    for r in rows:
        text, kind = r["near"], r["kind"]
        if kind < 0:
            examples.append((text, set()))
            continue
        examples.append((text, {(s, e, k) for k, s, e in base_spans(text)}))
        if again := _rewritten(text, kind, r["s"], r["e"], rng):
            examples.append(again)
    return Field().fit(examples)


def spans(text: str, field: Field) -> tuple[list, list]:
    """(base spans, all spans) as (kind number, start, end), by kind and start."""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    reach = np.maximum.accumulate([e for _, e in taken]) if taken else []

    def is_free(c):
        i = bisect_left(starts, c[1])
        return i == 0 or reach[i - 1] <= c[0]

    more = []
    for group in clusters(text):
        group = [c for c in group if is_free(c)]
        if group:
            more += [(k, s, e) for s, e, k in field.best(text, group)]
    return base, sorted(base + more)


def redact(text: str, found: list) -> str:
    """Each run of overlapping spans replaced by the kind of its first one."""
    out, at = [], 0
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{KINDS[kind].upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def find(docs: DataFrame, field: Field, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, then base and spans (arrays of kind, start, end; code points) and the redacted text."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(field))
    held = len(keep)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    names = [*docs.select(*keep).columns, "base", "spans", "redacted"]

    def run(batches):
        field = common.revived(Field, shared.value)
        named = lambda x: [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in x]
        for b in batches:
            base, every, text = [], [], []
            for t in b.column(held).to_pylist():
                x, y = spans(t, field) if t else ([], [])
                base.append(named(x)), every.append(named(y)), text.append(redact(t, y) if t and y else t)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(held)), pa.array(base, span), pa.array(every, span), pa.array(text, pa.string())], names=names)

    kind = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer"))
    schema = docs.select(*keep).schema.add("base", kind).add("spans", kind).add("redacted", "string")
    return docs.select(*keep, F.col(text)).mapInArrow(run, schema)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    found = find(docs, train(docs))
    of = lambda k: F.filter("base", lambda x: x["kind"] == k)
    n = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *n, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


