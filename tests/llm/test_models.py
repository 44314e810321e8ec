"""Trained operators: held-out accuracy, and defined results for odd inputs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import op2_quality, op5_toxicity, op9_langid

DOCS = "doc_id long, text string, lang string, score double, TEXT2 string"
LETTERS = {"en": "the of and ing tion er st re", "de": "sch ung ein der ich keit zu", "fr": "eau que ment ère oux des"}


def texts(rng, lang, n):
    s = LETTERS[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randrange(1, 4))) for _ in range(n))


ODD = [(9000, None, None, 0.0, ""), (9001, "", "en", 0.0, ""), (9002, "123 !!", None, 0.0, ""), (None, "the of", None, 0.0, ""), (9003, "the " * 60000, None, 0.0, ""), (9003, "the " * 60000, None, 0.0, "")]


def test_language(spark):
    rng = random.Random(1)
    rows = [(i, texts(rng, k, rng.randrange(5, 60)), k, 1.0, "x") for i, k in enumerate(list(LETTERS) * 40)]
    df = spark.createDataFrame(rows + ODD, DOCS)
    learned = op9_langid.profiles(df.where("doc_id % 4 <> 2"))
    got = op9_langid.predict(df, learned).collect()
    by = {r.doc_id: r for r in got}
    held = [(by[i].lang_pred, k) for i, _, k, *_ in rows if i % 4 == 2]
    assert np.mean([a == b for a, b in held]) >= 0.9 and len(got) == len(rows) + len(ODD)
    assert all(by[i].lang_pred == "und" and by[i].score == 0.0 for i in (9000, 9001, 9002))
    assert by[9003].lang_pred == "en" and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in op9_langid.predict(df, {}).collect()} == {"und"}
    assert op9_langid.predict(df.limit(0), op9_langid.profiles(df.limit(0))).count() == 0


@pytest.mark.parametrize("piece", [1, 2, 97])
def test_a_long_text_in_pieces_has_the_same_letters(monkeypatch, piece):
    for text in (texts(random.Random(2), "fr", 400), "a", "  x  ", "ab1c", "", "É è\n\nO"):
        whole = op9_langid._grams(text)
        with monkeypatch.context() as m:
            m.setattr(op9_langid, "PIECE", piece)
            parts = op9_langid._grams(text)
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, parts, strict=True))


def test_language_against_naive_cosines(spark):
    """Prototypes and cosines by definition: bound letters, bundled trigrams, the mean taken from both sides."""
    rng = random.Random(8)
    rows = [(i, texts(rng, k, rng.randrange(3, 20)), k) for i, k in enumerate(list(LETTERS) * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def bundle(text):
        total = np.zeros(op9_langid.DIM)
        words = text.lower().split()
        for w in words:
            padded = f" {w} "
            for i in range(len(w)):
                a, b, c = (op9_langid._letter_vectors(np.array([ord(x)]), op9_langid.DIM)[0].astype(float) for x in padded[i : i + 3])
                total += np.roll(a, 2) * np.roll(b, 1) * c
        return total / np.linalg.norm(total)

    sums = {k: sum(bundle(t) for _, t, lang in rows if lang == k) for k in LETTERS}
    names = sorted(sums)
    p = np.stack([sums[k] / np.linalg.norm(sums[k]) for k in names])
    mean = p.mean(axis=0)
    p = p - mean
    for r in op9_langid.predict(df, op9_langid.profiles(df), keep=("doc_id", "text")).collect():
        v = bundle(r.text) - mean
        cos = p @ v / np.linalg.norm(p, axis=1) / np.linalg.norm(v)
        assert r.lang_pred == names[int(np.argmax(cos))] and abs(r.score - (0.5 + cos.max() / 2)) < 1e-4


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(3)
    bad = ["scum", "trash", "fool", "vile"]
    rows, labels = [], []
    for i in range(400):
        w = texts(rng, "en", 60).split()
        y = int(i % 3 == 0)
        if y:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(w), "en", 1.0, "x"))
        labels.append((i, y))
    return spark.createDataFrame(rows + ODD, DOCS), labels


def test_toxicity(spark, toxic):
    df, labels = toxic
    y = spark.createDataFrame([x for x in labels if x[0] % 5] + [(9001, None), (9002, 7)], "doc_id long, toxic int")
    model, curve = op5_toxicity.train(df, y)
    by = {r.doc_id: r.score for r in op5_toxicity.score(df, model, curve).collect()}
    held = [(by[i] >= 0.5) == bool(t) for i, t in labels if i % 5 == 0]
    assert np.mean(held) >= 0.9 and all(0 <= s <= 1 for s in by.values())
    assert by[9000] == by[9001] < 0.5
    for only in (0, 1):
        m, c = op5_toxicity.train(df, y.where(f"toxic = {only}"))
        assert {r.score for r in op5_toxicity.score(df.limit(3), m, c).collect()} == {float(only)}
    assert op5_toxicity.score(df.limit(0), model, curve).count() == 0


def naive_kneser_ney(rows):
    """Log ratios by definition: {(before, word): (whole, continuation)} of rows (words, class)."""
    import math
    from collections import Counter

    pair = [Counter(), Counter()]
    for words, y in rows:
        pair[y].update(zip(["^", *words], words, strict=False))
    near = [Counter(w for _, w in pair[y]) for y in (0, 1)]
    history = [Counter() for _ in (0, 1)]
    for y in (0, 1):
        for (v, _), n in pair[y].items():
            history[y][v] += n
    kept = [k for k in pair[1] if pair[0][k] + pair[1][k] > 1]
    words = {w for w in near[0] | near[1]} | set(history[0] | history[1])
    size = sum(near[0].values()) + sum(near[1].values())

    def discount(c):
        one, two = sum(n == 1 for n in c), sum(n == 2 for n in c)
        return one / (one + 2 * two) if one else 0.5

    d = [discount(near[y].values()) for y in (0, 1)]
    top_d = [discount([pair[y][k] for k in kept]) for y in (0, 1)]
    left = [d[y] * len(near[y]) / sum(near[y].values()) for y in (0, 1)]

    def low(y, w):
        shared = (near[0][w] + near[1][w] + 0.5) / (size + 0.5 * len(words))
        return max(near[y][w] - d[y], 0) / sum(near[y].values()) + left[y] * shared

    def top(y, v, w):
        return max(pair[y][v, w] - top_d[y], 0) / max(1, history[y][v]) if (v, w) in kept else 0

    used = [Counter() for _ in (0, 1)]
    for y in (0, 1):
        for v, w in kept:
            used[y][v] += top(y, v, w)
    out = {}
    for v, w in pair[0] | pair[1]:
        x = math.log(low(1, w) / low(0, w)) if near[0][w] + near[1][w] > 1 else math.log(left[1] / left[0])
        l = [1 - used[y][v] for y in (0, 1)]
        whole = math.log((top(1, v, w) + l[1] * low(1, w)) / (top(0, v, w) + l[0] * low(0, w))) if (v, w) in kept else x + math.log(l[1] / l[0])
        out[v, w] = whole, x
    return out


def test_kneser_ney_against_its_definition(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        y = i % 2
        rows.append((i, " ".join(rng.choice("abcdefgh" + ("xyz" if y else "mno")) * rng.randrange(1, 3) for _ in range(rng.randrange(1, 25))), y))
    df = spark.createDataFrame([(t, y, 0) for _, t, y in rows], "text string, toxic int, fold int")
    tables = op5_toxicity.fit(op5_toxicity.counts(df))
    model = op5_toxicity.Model(tables, (0,))
    want = naive_kneser_ney([(t.split(), y) for _, t, y in rows])
    column = pa.array([t for _, t, _ in rows])
    for _, _, h, row in op5_toxicity._words(column):
        whole, x = model.ratios(h, row)
    at = 0
    for _, t, _ in rows:
        words = t.split()
        for v, w in zip(["^", *words], words, strict=False):
            assert np.allclose((whole[at], x[at]), want[v, w], atol=1e-5)
            at += 1
    assert at == len(whole)
    # beyond the broadcast bound the tokens are joined with the same entries
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(90, None), (91, ""), (91, rows[3][1]), (None, rows[4][1])], "doc_id long, text string")
    for r in op5_toxicity._joined_features(docs, tables, 0, "text", ("doc_id", "text")).collect():
        assert np.allclose(r.x, model.features(pa.array([r.text], pa.string()))[0], atol=1e-5)


def test_whole_kneser_ney_leaves_no_pair_out(spark):
    """Pairs of ordinary text, pairs seen once and words of one context count by definition, in all three ways to score."""
    import math
    from collections import Counter

    rng = random.Random(8)
    texts_ = [(" ".join(rng.choice("abcdefgh" + ("xyz" if i % 2 else "mno")) for _ in range(rng.randrange(1, 25))), i % 2) for i in range(40)] + [("a onlyonce b", 0)]
    pair = [Counter(), Counter()]
    for t, y in texts_:
        pair[y].update(zip(["^", *t.split()], t.split(), strict=False))
    near = [Counter(w for _, w in pair[y]) for y in (0, 1)]
    history, after = [Counter(), Counter()], [Counter(v for v, _ in pair[y]) for y in (0, 1)]
    for y in (0, 1):
        for (v, _), n in pair[y].items():
            history[y][v] += n
    discount = lambda c: (lambda one, two: one / (one + 2 * two) if one else 0.5)(sum(n == 1 for n in c), sum(n == 2 for n in c))
    d, top = ([discount(x[y].values()) for y in (0, 1)] for x in (near, pair))
    size, words = sum(near[0].values()) + sum(near[1].values()), len(set(near[0]) | set(near[1]) | {"^"})
    left = [d[y] * len(near[y]) / sum(near[y].values()) for y in (0, 1)]
    low = lambda y, w: max(near[y][w] - d[y], 0) / sum(near[y].values()) + left[y] * (near[0][w] + near[1][w] + 0.5) / (size + 0.5 * words)
    p = lambda y, v, w: max(pair[y][v, w] - top[y], 0) / max(1, history[y][v]) + (top[y] * after[y][v] / history[y][v] if history[y][v] else 1) * low(y, w)
    tables = op5_toxicity.fit(op5_toxicity.counts(spark.createDataFrame([(t, y, 0) for t, y in texts_], "text string, toxic int, fold int")), whole=True)
    assert tables.pairs.count() == len(pair[0] | pair[1])
    model = op5_toxicity.Model(tables, (0,))
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts_)] + [(90, None), (90, texts_[0][0]), (None, "new words a b")], "doc_id long, text string")
    for i, (t, _) in enumerate(texts_):
        x = [math.log(p(1, v, w) / p(0, v, w)) for v, w in zip(["^", *t.split()], t.split(), strict=False)]
        assert np.allclose(model.features(pa.array([t]))[0][:2], [sum(x) / len(x), sum(x) / len(x) ** 0.5], atol=1e-4), i
    for bound in (op5_toxicity.BROADCAST, 0):
        got = op5_toxicity._joined_features(docs, tables, 0, "text", ("doc_id", "text"), bound).collect()
        assert len(got) == len(texts_) + 3
        for r in got:
            assert np.allclose(r.x, model.features(pa.array([r.text], pa.string()))[0], atol=1e-5)


def test_toxicity_beyond_the_broadcast(spark, toxic):
    df, labels = toxic
    y = spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, toxic int")
    got = []
    for bound in (op5_toxicity.BROADCAST, 0):
        model, curve = op5_toxicity.train(df, y, broadcast=bound)
        got.append(sorted((str(r.doc_id), round(r.score, 3)) for r in op5_toxicity.score(df, model, curve).collect()))
    assert got[0] == got[1]


@pytest.mark.parametrize("slices", [1, 3])
def test_whole_toxicity_without_stored_pairs(spark, toxic, monkeypatch, slices):
    """The query's way gives what the stored model gives: odd rows, repeated rows and labels, few tokens at a time."""
    df, labels = toxic
    df = df.unionByName(df.limit(40))
    y = spark.createDataFrame([x for x in labels if x[0] % 5] + labels[1:4] + [(9001, None), (9002, 7)], "doc_id long, toxic int")
    want = op5_toxicity.score(df, *op5_toxicity.train(df, y)).collect()
    monkeypatch.setattr(op5_toxicity, "HELD", 4_000)
    monkeypatch.setattr(op5_toxicity, "fit", None)  # no table of pairs is made
    got = op5_toxicity.scored(df, y, slices=slices).collect()
    order = lambda rows: sorted(((str(r.doc_id), r.score) for r in rows))
    assert [k for k, _ in order(got)] == [k for k, _ in order(want)]
    assert np.allclose([x for _, x in order(got)], [x for _, x in order(want)], atol=1e-5)


def test_whole_toxicity_of_one_class(spark, toxic):
    df, labels = toxic
    for only in (0, 1):
        y = spark.createDataFrame([x for x in labels if x[1] == only], "doc_id long, toxic int")
        assert {r.score for r in op5_toxicity.scored(df.limit(3), y).collect()} == {float(only)}
    assert op5_toxicity.scored(df.limit(0), y).count() == 0


def test_packed_columns_come_back():
    a, b = np.array([3, 3, 9, 2**63 + 5], np.uint64), np.array([0.5, -1.0], np.float32)
    c = [np.array(x, np.uint64) for x in ([0, 300, 2**40], [])]
    for x, y in zip((a, b, *c), op5_toxicity._unpacked(op5_toxicity._packed(a, b, *c)), strict=True):
        assert x.tolist() == y.tolist()


def test_quality(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        t = texts(rng, rng.choice(list(LETTERS)), 50)
        rows.append((i, t if good else rng.choice([t.upper().replace(" ", "!! "), t.replace(" ", "%%% "), t.split()[0] * 1 + " " + (t.split()[0] + " ") * 40]), "en", 1.0, "x"))
        labels.append((i, int(good)))
    df = spark.createDataFrame(rows + ODD, DOCS)
    y = spark.createDataFrame([x for x in labels if x[0] % 5] + [(9001, None)], "doc_id long, quality int")
    vectors, net = op2_quality.train(df, y)
    by = {r.doc_id: r.score for r in op2_quality.score(df, vectors, net).collect()}
    held = [(by[i] >= op2_quality.THRESHOLD) == bool(q) for i, q in labels if i % 5 == 0]
    assert np.mean(held) >= 0.9 and all(0 <= s <= 1 for s in by.values()) and by[9000] == by[9001]
    v, none = op2_quality.train(df, y.limit(0))
    assert {r.score for r in op2_quality.score(df.limit(2), v, none).collect()} == {0.5}
    v, one = op2_quality.train(df, y.where("quality = 1"))
    assert {r.score for r in op2_quality.score(df.limit(2), v, one).collect()} == {1.0}
    assert op2_quality.score(df.limit(0), vectors, net).count() == 0


def test_quality_scores_against_naive_loops(spark):
    """Word vectors, pooling and the network by definition, on a tiny corpus."""
    import re

    rows = ["Ab cd, 12 cd", "cd ab ab!", "", None, "x" * 3 + " cd cd Ab 7"]
    kinds = re.compile(r"[a-z]+|[A-Z]+|[0-9]+|[!-/:-@\\[-`{-~]+")
    tokens = [kinds.findall(t or "") for t in rows]
    data = "\n".join(t or "" for t in rows)
    known = {}
    for _, _, _, h, _ in op2_quality._tokens(pa.array(sorted({w for t in tokens for w in t}))):
        known = dict(zip(sorted({w for t in tokens for w in t}), h.tolist(), strict=True))
    assert data and len(set(known.values())) == len(known)
    cells = np.zeros((op2_quality.VOCAB, op2_quality.DIM))
    for t in tokens:
        for i, w in enumerate(t):
            for j, other in enumerate(t):
                if i != j and abs(i - j) <= op2_quality.REACH:
                    h = known[other]
                    for place, sign in ((20, 40), (30, 41)):
                        cells[known[w] % op2_quality.VOCAB, (h >> place) % op2_quality.DIM] += 1 if (h >> sign) & 1 else -1
    cells /= np.maximum(np.linalg.norm(cells, axis=1, keepdims=True), 1e-9)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    vectors = op2_quality.word_vectors(df)
    assert np.allclose(vectors, cells, atol=1e-6)
    rng = np.random.default_rng(1)
    width = 3 * op2_quality.DIM + 1
    net = {"a": rng.normal(size=(width, 4)), "b": rng.normal(size=4), "c": rng.normal(size=4), "d": np.array([0.3]), "mean": rng.normal(size=width), "scale": rng.random(width) + 0.5, "t": 1.7}
    got = {r.doc_id: r.score for r in op2_quality.score(df, vectors, net).collect()}
    for i, t in enumerate(tokens):
        v = np.array([cells[known[w] % op2_quality.VOCAB] for w in t])
        x = np.concatenate((v.mean(0), v.std(0), v.max(0), [np.log1p(len(t))])) if len(t) else np.zeros(width)
        z = [min(8, max(-8, (x[k] - net["mean"][k]) / net["scale"][k])) for k in range(width)]
        hidden = [np.tanh(sum(z[k] * net["a"][k, j] for k in range(width)) + net["b"][j]) for j in range(4)]
        score = 1 / (1 + np.exp(-(sum(h * c for h, c in zip(hidden, net["c"], strict=True)) + 0.3) / 1.7))
        assert abs(got[i] - score) < 1e-4


def test_temperature_is_fitted_on_rows_not_trained_on():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5)).astype(np.float32)
    y = (x[:, 0] + rng.normal(size=600) > 0).astype(int)
    p = op2_quality.probability(x, op2_quality.fit_network(x, y))
    assert abs(p.mean() - y.mean()) < 0.1 and ((p > 0.5) == y).mean() > 0.7


def test_quality_features_reach_the_driver_packed(spark, monkeypatch):
    """Features come as bytes, some 400 a row, not as an object a number; the network is that of rows pooled here."""
    rng = random.Random(4)
    rows = [(i, texts(rng, "en", 40) if i % 3 else texts(rng, "de", 40).upper()) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    y = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows], "doc_id long, quality int")
    seen = []
    for name in ("collect", "toPandas", "toArrow"):
        plain = getattr(type(df), name)
        monkeypatch.setattr(type(df), name, lambda self, *a, plain=plain, **k: seen.append(self.dtypes) or plain(self, *a, **k))
    vectors, net = op2_quality.train(df, y)
    monkeypatch.undo()
    assert seen and not [t for columns in seen for _, t in columns if t.startswith("array")]
    x = op2_quality.pooled(pa.array([t for _, t in rows]), vectors)
    q = np.array([int(i % 3 > 0) for i, _ in rows])
    order = np.lexsort((*x.T[:8], q))
    want = op2_quality.fit_network(x[order].astype(np.float64), q[order])
    assert all(np.allclose(net[k], want[k], rtol=1e-6, atol=1e-9) for k in want)
