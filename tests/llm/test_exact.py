"""Operators with an exact result, against brute force on small fixtures."""

import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import doubling, op1_suffix, op3_recompression, op4_pii, op6_packing, op7_minhash, op8_topk, op10_decontam
from ledgerline.llm.components import components

SEP = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string"


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randrange(2, 8))) for _ in range(150)]
    shared = [" ".join(rng.choice(words) for _ in range(rng.randrange(15, 80))) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(2)]
        if rng.random() < 0.6:
            parts.insert(1, rng.choice(shared))
        rows.append((i, rng.choice([" ", "\n"]).join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, "né " * 300), (n + 3, rows[3][1]), (n + 4, rows[5][1] + " tail"), (None, rows[7][1]), (n + 5, "x")]
    rows.append(rows[2])  # a repeated row
    return rows


def frame(spark, rows, extra=True):
    """Rows with further columns whose names the operators use inside."""
    if not extra:
        return spark.createDataFrame(rows, DOCS)
    return spark.createDataFrame([(*r, "k", 1.0, 7) for r in rows], DOCS + ", key string, score double, DOC int")


def brute_bytes(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        cut = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cut[i] += 1
                cut[i + length] -= 1
        gone = np.cumsum(cut)[:-1] > 0
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length,kmer,group,chunk", [(60, 20, 4, 1 << 20), (40, 16, 16, 100), (100, 60, 1, 1 << 20)])
def test_suffix_dedup(spark, monkeypatch, length, kmer, group, chunk):
    monkeypatch.setattr(op1_suffix, "GROUP", group)
    monkeypatch.setattr(op1_suffix.scheme, "__defaults__", (length, kmer, group))
    monkeypatch.setattr(op1_suffix, "CHUNK", chunk)
    rows = corpus()
    got = op1_suffix.dedup(frame(spark, rows), length, kmer, text_out=False).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_bytes(rows, length)


@pytest.mark.parametrize("length", [7, 40, 61])
def test_plain_prefix_doubling(spark, length):
    rows = corpus(3, 14)
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "row long, text string")
    seen = {}
    for i, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], []).append((i, p))
    want = {x for v in seen.values() if len(v) > 1 for x in v}
    assert {(r.row, r.pos) for r in doubling.repeated_positions(docs, length).collect()} == want and want
    assert doubling.repeated_positions(docs.limit(0), length).count() == 0


def test_suffix_dedup_of_nothing(spark):
    assert op1_suffix.dedup(frame(spark, [(1, "a")]).limit(0)).count() == 0
    r = op1_suffix.dedup(frame(spark, [(1, None)])).first()
    assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.kept) == (0, 0, 0, hashlib.sha256(b"").hexdigest(), b"")


def brute_words(rows, window):
    split = [(doc, re.findall(SEP, t or "")) for doc, t in rows]
    first = {}
    for doc, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, float("inf")), float("inf") if doc is None else doc)
    out = []
    for doc, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (float("inf") if doc is None else doc):
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,seed", [(13, 1), (20, 2)])
def test_recompression(spark, window, seed):
    rows = corpus(seed)
    got = op3_recompression.dedup(frame(spark, rows), window, text_out=False).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_words(rows, window)


def test_recompression_keeps_text_and_takes_no_rows(spark):
    a = " ".join(f"w{i}" for i in range(20))
    got = {r.doc_id: r.kept for r in op3_recompression.dedup(spark.createDataFrame([(1, a), (2, "x  " + a + "\ny")], DOCS)).collect()}
    assert got == {1: a, 2: "x y"}
    assert op3_recompression.dedup(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        op3_recompression.scheme(12)


def test_rows_without_an_id_have_keys_of_their_own(spark):
    """They are later than all others, no earlier document to each other, and not sent to one task."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a), (None, a + " " + b), (None, b), (None, b), (7, c), (None, c), ((1 << 63) - 1, c), (6, a)]
    for shuffled in (False, True):
        got = {(r.doc_id, r.n_words, r.n_removed) for r in op3_recompression.dedup(spark.createDataFrame(rows, DOCS).repartition(3 if shuffled else 1), 13, text_out=False).collect()}
        assert got == {(5, 30, 0), (None, 60, 30), (None, 30, 0), (7, 30, 0), (None, 30, 30), ((1 << 63) - 1, 30, 30), (6, 30, 30)}


def test_recompression_of_long_texts(spark, monkeypatch):
    """A text longer than a piece gives the rows that brute force gives, whatever side of a joint its repeats lie on."""
    rng = random.Random(12)
    words = [f"w{rng.randrange(40)}" for _ in range(900)]
    rows = [(1, " ".join(words[:400])), (2, " ".join(words)), (3, "x " + " ".join(words[80:130]) + " y"), (4, " ".join(words[95:115])), (5, " ".join(f"u{i}" for i in range(500))), (6, " ".join(f"u{i}" for i in range(90, 260)))]
    whole = sorted((tuple(r) for r in op3_recompression.dedup(spark.createDataFrame(rows, DOCS), 13, text_out=False).collect()), key=str)
    assert whole == brute_words(rows, 13)
    monkeypatch.setattr(op3_recompression, "PIECE", 100)
    assert sorted((tuple(r) for r in op3_recompression.dedup(spark.createDataFrame(rows, DOCS), 13, text_out=False).collect()), key=str) == whole


def test_symbols_name_equal_insides_equally():
    rng = np.random.default_rng(0)
    inner = rng.integers(1, 1 << 60, 40).astype(np.uint64)
    found = []
    for seed in (1, 2):
        around = np.random.default_rng(seed).integers(1, 1 << 60, 20).astype(np.uint64)
        at, name = op3_recompression.symbols(np.concatenate((around[:10], inner, around[10:])), np.zeros(60, np.int64))
        found.append({(int(a) - 10, int(n)) for a, n in zip(at, name, strict=True) if 13 <= a < 43})
    assert found[0] == found[1] and found[0]


def groups(rows, width, percent):
    fold = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    sets = []
    for _, t in rows:
        w = re.findall(SEP, (t or "").translate(fold))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i] = up[up[i]]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) or rows[i][0] is not None and rows[i][0] == rows[j][0] and a and b:
                up[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return sorted(((doc, len(s), low.get(find(i)) if s else doc, doc == (low.get(find(i)) if s else doc)) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def hot(seed, n, edits):
    """Copies of one text with from none to many changed words."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice(edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**7)}"
        if rng.random() < 0.2:
            del w[: rng.randrange(20)]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("width,edits", [(2, (0, 1, 3, 8, 10, 14, 20, 40)), (5, (1, 2, 3, 5)), (2, (9, 10, 11, 12, 13))])
def test_near_duplicates_in_a_hot_group(spark, width, edits):
    rows = hot(width, 150, edits)
    got = op7_minhash.near_duplicates(spark.createDataFrame(rows, DOCS), width, 80).collect()
    assert sorted((tuple(r) for r in got), key=str) == groups(rows, width, 80)


def test_hot_group_whose_first_ids_are_edited_most(spark):
    """Every text is linked to the unedited one, whose large buckets mostly have another first id."""
    rng = random.Random(2)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for i in range(161):
        w = list(base)
        for k in rng.sample(range(200), 20 if i < 4 else 0 if i == 4 else 12):
            w[k] = f"e{i}x{k}"
        assert 100 * len(set(w) & set(base)) >= 80 * len(set(w) | set(base))
        rows.append((i, " ".join(w)))
    got = op7_minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 1, 80).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(i, 0, i == 0) for i in range(161)]


def test_near_duplicates_of_very_long_texts(spark):
    rng = random.Random(21)
    long = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    other = list(long)
    for i in range(0, 60_000, 20):
        other[i] = f"e{i}"
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(reversed(long))), (4, "short"), (5, " ".join(long))]
    got = op7_minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 2, 80).collect()
    assert sorted((tuple(r) for r in got), key=str) == groups(rows, 2, 80) and {r.component_id for r in got if r.doc_id in (1, 2, 5)} == {1}


def test_differences_are_cut_before_they_are_dealt(spark, monkeypatch):
    """Members of a bucket that are far from its centre give no row for each shingle of their difference."""
    import numpy as np

    from ledgerline.llm import common, op7_minhash

    rng, seen, real = np.random.default_rng(5), {}, common.checkpointed

    def told(df):
        out = real(df)
        if {"differ", "d"} <= set(out.columns):
            seen["whole"] = out.agg({"d": "sum"}).first()[0]
        elif {"key", "rep", "d"} <= set(out.columns):
            seen.setdefault("dealt", out.count())
        return out

    monkeypatch.setattr(common, "checkpointed", told)
    same = " ".join(f"s{i}" for i in range(60))
    docs = spark.createDataFrame([(i, same + " " + " ".join(f"w{x}" for x in rng.integers(0, 10**6, 40))) for i in range(60)], "doc_id long, text string")
    assert op7_minhash.near_duplicates(docs, 2, 80).where("not kept").count() == 0
    assert seen["dealt"] < 0.6 * seen["whole"]


def test_few_pairs_of_a_hot_group_are_compared(spark, monkeypatch):
    """Members that share a few frequent shingles of their differences to the centre, too few for a link, give no pairs."""
    rng, seen, real = random.Random(8), [], op7_minhash._compared

    def told(docs, pairs, *more):
        seen.append(pairs.count())
        return real(docs, pairs, *more)

    monkeypatch.setattr(op7_minhash, "_compared", told)
    base, rows = [f"b{k}" for k in range(150)], []
    for i in range(300):
        w = list(base)
        for k in rng.sample(range(150), rng.randrange(2, 15) if i % 3 == 0 else rng.randrange(17, 24)):
            w[k] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    rows += [(300 + i, t + " tail") for i, t in rows[1:30:3]]
    got = op7_minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 1, 80).collect()
    assert sorted((tuple(r) for r in got), key=str) == groups(rows, 1, 80)
    assert len({r.component_id for r in got}) > 100 and len(seen) == 2 and seen[1] < 2 * len(rows)


def test_rows_of_one_id_in_several_classes(spark):
    """A shared id connects its classes, whichever of them holds the smallest id."""
    for rows in ([(3, "b b2 b3"), (5, "b b2 b3"), (5, "a a2 a3")], [(9, "x x1"), (2, "x x1"), (9, "y y1"), (9, "z z1"), (4, "z z1"), (None, "y y1"), (7, "q q1")]):
        got = op7_minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 2, 80).collect()
        assert sorted((tuple(r) for r in got), key=str) == groups(rows, 2, 80)


def test_near_duplicates_in_a_mixed_corpus(spark):
    rows = corpus(5) + [(900, "One"), (901, "one"), (902, "ONE two"), (903, " \n ")]
    got = op7_minhash.near_duplicates(frame(spark, rows), 2, 80).collect()
    assert sorted((tuple(r) for r in got), key=str) == groups(rows, 2, 80)
    assert op7_minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("bound", [500_000, 0])
def test_components_of_chains_and_stars(spark, monkeypatch, bound):
    from ledgerline.llm import components as module

    monkeypatch.setattr(module, "BROADCAST_EDGES", bound)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_top_k(spark):
    rng = random.Random(3)
    vec = [[rng.choice([0.0, rng.gauss(0, 1), -0.5]) for _ in range(9)] for _ in range(120)]
    rows = [(i, vec[i % 100], 1) for i in range(120)] + [(200, None, 1), (201, [], 1), (202, [1.0, None], 1), (203, [float("nan")], 1), (250, [float("inf")], 1), (None, [1.0], 1), (51, vec[50], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    v = op8_topk.integer_vectors(df)
    got = {tuple(r) for r in op8_topk.top_k(v, v.where("vec_id % 50 = 0"), 5, block=2).collect()}
    ints = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e, _ in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    want = set()
    for q, a in {i: e for i, e in ints if i % 50 == 0}.items():
        best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ints if i != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert got == want
    assert op8_topk.top_k(v.limit(0), v.limit(0)).count() == 0


@pytest.mark.parametrize("largest", [1, 10**6, 10**8, 4 * 10**8])
def test_shard_search_against_brute_force(largest):
    """Later shards are pruned by the floors of earlier ones; sums of any size are exact."""
    rng = np.random.default_rng(largest % 97)
    m = rng.integers(-largest, largest + 1, (300, 40)) * rng.choice([0, 1, 1, 3], (300, 1))
    queries, ids = m[:7], np.arange(300)
    floors, best = np.full(7, float("-inf")), [[] for _ in range(7)]
    for a, b in ((0, 40), (40, 300)):
        for j, found, score in op8_topk.Shard(ids[a:b], m[a:b]).search(ids[:7], queries, 5, floors):
            best[j] = sorted(best[j] + [(-int(s), int(i)) for i, s in zip(found, score, strict=True)])[:5]
            floors[j] = -best[j][-1][0]
    for j in range(7):
        want = sorted((-sum(int(x) * int(y) for x, y in zip(queries[j], m[i], strict=True)), i) for i in range(300) if i != j)[:5]
        assert best[j] == want


def test_masks_hit_every_window_with_two_substitutions():
    from itertools import combinations

    for errors in combinations(range(op10_decontam.WINDOW), op10_decontam.SLACK):
        assert any(all(s + o not in errors for o in m) for m in op10_decontam.MASKS for s in range(op10_decontam.WINDOW - m[-1]))


def test_decontamination(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    item = [rng.choice(words) for _ in range(30)]
    items = [(1, " ".join(item)), (2, "too short an item"), (3, "a b c d e f g h"), (None, "x"), (5, None), (1, " ".join(item)), (6, "Solo"), (7, "two words"), (8, "")]

    def doc(change, cut=30):
        w = list(item[:cut])
        for i in change:
            w[i] = "zz"
        return " ".join(rng.choice(words) for _ in range(50)) + ". " + ", ".join(w).upper() + " " + " ".join(rng.choice(words) for _ in range(20))

    rows = [(1, doc([])), (2, doc([3, 9, 15, 21, 27])), (3, doc(range(0, 30, 3))), (4, doc([], 13)), (5, doc([], 10)), (6, None), (7, ""), (8, "q A b c d e f g H q"), (1, doc([])), (10, "x solo"), (11, "two, WORDS and two words"), (12, "two other words"), (13, "solo"), (14, "this is too short an item " * 3000)]
    got = {(r.doc_id, r.item_id) for r in op10_decontam.overlaps(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}

    def overlaps(text, words_of):
        d, n = re.findall(r"[^\W_]+", text.lower()), min(len(words_of), 13)
        return any(sum(d[s + i] == words_of[k + i] for i in range(n)) >= (11 if len(words_of) >= 13 else n) for k in range(len(words_of) - n + 1) for s in range(len(d) - n + 1))

    want = {(i, k) for i, t in rows if t for k, w in ((1, item), (2, ["too", "short", "an", "item"]), (3, list("abcdefgh")), (6, ["solo"]), (7, ["two", "words"])) if overlaps(t, w)}
    assert got == want and {(1, 1), (2, 1), (4, 1), (8, 3), (10, 6), (11, 7), (13, 6), (14, 2)} <= got
    assert op10_decontam.overlaps(frame(spark, rows).limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert op10_decontam.overlaps(frame(spark, rows), spark.createDataFrame([], "item_id long, text string")).count() == 0
    left = op10_decontam.clean(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in left.collect()} == {i for i, _ in rows} - {i for i, _ in want} and "score" in left.columns


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and op4_pii.luhn(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]


def test_base_spans_agree_with_the_patterns():
    rng = random.Random(3)
    for _ in range(5000):
        t = "".join(rng.choice(rng.choice(["ab@.-", "0123456789 -", ".@1+ ()", "12.", "é@a."])) for _ in range(rng.randrange(60)))
        assert op4_pii.base_spans(t) == brute_spans(t)


def test_pii_field_adds_and_base_stays(spark):
    field = op4_pii.Field().fit(op4_pii.generated(random.Random(11)))
    text = "call (988) 555-2485 or a.b@c.example.com, 4111.1111.1111.1111, on 2024-01-15, id 452413226"
    base, every = op4_pii.spans(text, field)
    assert [text[s:e] for _, s, e in base] == ["a.b@c.example.com"]
    assert {text[s:e] for _, s, e in every} == {"a.b@c.example.com", "(988) 555-2485", "4111.1111.1111.1111"}
    assert op4_pii.redact(text, every).startswith("call <PHONE> or <EMAIL>, <CARD>, on 2024-01-15")
    rows = [(1, text), (2, None), (3, ""), (1, text)]
    got = {r.doc_id: (len(r.base), len(r.spans), r.redacted) for r in op4_pii.find(frame(spark, rows), field).collect()}
    assert got[1][:2] == (1, 3) and got[2] == (0, 0, None) and got[3] == (0, 0, "")
    assert op4_pii.find(frame(spark, rows).limit(0), op4_pii.train(frame(spark, rows).limit(0))).count() == 0


def test_pii_of_very_long_texts(spark):
    text = ("word " * 3000 + "a.b@c.org 10.0.0.1 +1 555 123 4567 or 4111 1111 1111 1111, ") * 40 + "1" * 5000 + " " + "x" * 100_000
    got = op4_pii.find(spark.createDataFrame([(1, text), (2, None), (3, "")], DOCS), op4_pii.Field()).collect()
    found = {r.doc_id: [(op4_pii.KINDS.index(s.kind), s.start, s.end) for s in r.base] for r in got}
    assert sorted(found[1]) == sorted(brute_spans(text)) and len(found[1]) >= 160 and found[2] == found[3] == []


def segmentations(group):
    """All sets of candidates that do not overlap, in order of place."""
    if not group:
        return [[]]
    first, rest = group[0], group[1:]
    return segmentations(rest) + [[first, *x] for x in segmentations([c for c in rest if c[0] >= first[1] or c[1] <= first[0]])]


def test_segmentation_against_enumeration():
    """best() is the segmentation of highest score and expected() the mean over all of them."""
    rng = random.Random(4)
    text = "call 555-123-4567 or 4111 1111 1111 1111 now, mail joe at mail dot com 10.1.2.3 99"
    groups_ = [g for g in op4_pii.clusters(text) if len(g) <= 14] + [op4_pii.clusters("12 345 678 901")[0]]
    assert any(len(g) > 3 for g in groups_)
    for g in groups_:
        field = op4_pii.Field()
        field.w[:] = np.array([[rng.gauss(0, 1) for _ in range(op4_pii.N_FEATURES)] for _ in range(4)])
        field.t[:] = np.array([[rng.gauss(0, 1) for _ in range(4)] for _ in range(5)])
        source = text if all(c[1] <= len(text) and any(c in x for x in op4_pii.clusters(text)) for c in g) else "12 345 678 901"
        ways = {tuple(sorted(x)) for x in segmentations(sorted(g))}

        def value(way, field=field, source=source):
            last, total = 4, 0.0
            for c in way:
                total += field.score(source, c) + field.t[last, c[2]]
                last = c[2]
            return total

        best = max(ways, key=value)
        assert abs(value(tuple(field.best(source, g))) - value(best)) < 1e-9
        z = sum(np.exp(value(w)) for w in ways)
        p, _ = field.expected(g, [op4_pii.features(source, *c) for c in g])
        for i, c in enumerate(g):
            assert abs(p[i] - sum(np.exp(value(w)) for w in ways if c in w) / z) < 1e-9


def test_packing(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 300))) + f" u{i % 50}", rng.choice(["hot", "hot", f"s{i % 9}", None])) for i in range(200)]
    rows += [(900, None, "x"), (901, "  ", "x"), (7, rows[7][1], rows[7][2])]
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", source string, bin int")
    got = op6_packing.pack(df, capacity=100, shard_rows=64).toPandas()
    words = {}
    for i, t, _ in rows:
        words[i] = words.get(i, 0) + len((t or "").split())
    assert got.groupby("doc_id").n_words.sum().to_dict() == {i: n for i, n in words.items() if n}
    assert got.groupby(["shard", "bin"]).n_words.sum().max() <= 100
    source, text = {r[0]: r[2] for r in rows}, {r[0]: (r[1] or "").lower().split() for r in rows}
    for _, g in got.groupby(["shard", "bin"]):
        own = [source[d] for d in g.doc_id if source[d] is not None]
        assert len(own) == len(set(own))
        copies = [tuple(text[d]) for d in g.doc_id]
        assert len(copies) == len(set(copies))
    assert op6_packing.pack(df.limit(0)).count() == 0


def naive_packing(pieces, capacity):
    """Best fit by looking at every bin: (piece number -> bin) of pieces (size, source, cluster) in the order given."""
    bins, out = [], {}
    for k, (size, source, cluster) in enumerate(pieces):
        fits = [(room, b) for b, (room, sources, clusters) in enumerate(bins) if room >= size and (source is None or source not in sources) and cluster not in clusters]
        b = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([capacity, set(), set()])
        bins[b][0] -= size
        bins[b][1].add(source), bins[b][2].add(cluster)
        out[k] = b
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_packing_against_naive_best_fit(seed):
    """The same bins as a search over all of them, with hot sources, copies, ties and texts of several bins."""
    import pandas as pd

    rng = random.Random(seed)
    rows = [(0, i, rng.choice([rng.randrange(1, 260), 40, 100]), rng.choice(["hot", "hot", "a", "b", None]), rng.randrange(60)) for i in range(150)]
    got = op6_packing.pack_shard(pd.DataFrame(rows, columns=["shard", "doc_id", "n_words", "source", "cluster"]), 100)
    ordered = sorted(rows, key=lambda r: (-r[2], r[1]))
    tails = sorted(((n % 100, doc, source, cluster) for _, doc, n, source, cluster in ordered if n % 100), key=lambda x: -x[0])
    want = naive_packing([(n, s, c) for n, _, s, c in tails], 100)
    found = {r.doc_id: r.bin for r in got.itertuples() if r.n_words < 100}
    assert found == {doc: want[k] for k, (_, doc, _, _) in enumerate(tails)}
    full = got[got.n_words == 100]
    assert sorted(full.bin) == list(range(max(want.values()) + 1, max(want.values()) + 1 + sum(n // 100 for _, _, n, _, _ in rows)))


def test_repeated_rows_are_dealt_over_shards(spark):
    df = spark.createDataFrame([(1, "a b c", "s")] * 60 + [(2, "d e", None)] * 3, DOCS + ", source string")
    got = op6_packing.pack(df, capacity=10, shard_rows=8).toPandas()
    assert len(got) == 63 and got[got.doc_id == 1].groupby("shard").size().max() < 30 and got.groupby(["shard", "bin"]).doc_id.apply(lambda d: d.is_unique).all()


def test_best_fit_takes_the_tightest_compatible_bin():
    b = op6_packing.Bins()
    assert [b.place(60, 1, 0, 100), b.place(50, 2, 0, 100), b.place(40, 2, 0, 100), b.place(45, 1, 0, 100), b.place(5, 4, 0, 100)] == [0, 1, 0, 1, 1]


def test_arrow_bytes_of_slices():
    data, offsets = op1_suffix.common.arrow_bytes(pa.array(["ab", None, "é", ""])[1:])
    assert data.tobytes() == "é".encode() and offsets.tolist() == [0, 0, 2, 2]
