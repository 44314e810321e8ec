"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney word models, one of toxic and one of ordinary text.
Class bigrams back off to class continuation counts (in how many distinct left
contexts a word was seen), and those to continuation counts that both classes
share, so that a rare expression costs both about the same.  All counts are exact,
keyed by word and by pair, and taken from every labelled row in one exchange by
word; they grow with the input.  Every pair of the labelled rows is in the bigram
order and every word in the continuation order.  (``fit`` alone gives the usual
pruned model: a word with a single context is unknown, and the bigram order keeps
pairs that toxic text holds and that occur twice at least.)

A document's features are its length-normalised log-likelihood ratio over the
whole text, and the greatest length-normalised ratio of the continuation order
over spans of a few words (a copied passage shows its words after the same words
each time, which continuation counts see through).  A logistic curve, fitted on
cross-fitted features (each half of the rows scored by the other half's counts),
turns them into a probability.

``scored`` learns and scores in one: it broadcasts the words, packed, and no table of
pairs is stored.  A model that is kept (``train``, ``score``) is broadcast up to
BROADCAST entries; beyond, only its words are, and a text's pairs are joined with the
others; what they add to its ratio is a sum.  Where the words alone are too many,
tokens are joined with them too, in ``scored`` as well.

Defined cases: null and empty texts get the score of a text without evidence;
null labels are not learned; with one class missing every score is 0.0 (or 1.0
when only toxic rows are known); repeated rows count and are scored each;
further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Labelled rows at most on which the logistic curve is fitted (counts use them all).
CURVE_ROWS = 40_000
#: Words of the spans whose best ratio is a feature.
SPANS = (24, 4, 2, 1)
#: Entries (words and pairs, some 30 bytes each) up to which the model is broadcast.
BROADCAST = 6_000_000
#: Tokens that a worker counts before it hands the counts on.
HELD = 2_000_000
#: Slices of all pairs that ``scored`` takes one after the other; the fewer, the more disk at once.
SLICES = 4
#: Left context of a text's first word.
START = np.uint64(0x5851F42D4C957F2D)
#: The models: of all labelled rows, and of those outside each fold.
MODELS = ("all", "not0", "not1")


def _words(column: pa.Array):
    """(word hash, row) of each word of a column, block by block."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    data, offsets = common.arrow_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    classes = common.letter_classes()
    for a, b in common.blocks(offsets):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        s, e, row = common.tokens(part, own, classes)
        yield a, b, common.token_hashes(part, s, e), row


def _before(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The word before each word, START for the first of a text."""
    out = np.concatenate((h[:1], h[:-1]))
    if len(h):
        out[np.concatenate(([True], row[1:] != row[:-1]))] = START
    return out


def pair_keys(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return common.mix(before * common.BASE + h)


def counts(labelled: DataFrame) -> DataFrame:
    """(w, v, c00, c01, c10, c11): occurrences of word w after v by class and fold, and with null v those of w before any word, from rows (text, toxic, fold)."""
    schema = "w long, v long, c00 long, c01 long, c10 long, c11 long"

    def table(w, v, kind, null=False):
        key = w if null else pair_keys(v, w)
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        n = np.stack([np.add.reduceat((kind[order] == k).astype(np.int64), first) for k in range(4)])
        # rows of a word together compress well on their way to the word's partition
        by_word = np.argsort(w[order[first]], kind="stable")
        at, n = order[first][by_word], n[:, by_word]
        left = pa.nulls(len(at), pa.int64()) if null else pa.array(v[at].view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(w[at].view(np.int64)), left, *(pa.array(x) for x in n)], names=[x.split()[0] for x in schema.split(", ")])

    def run(batches):
        held, n = [], 0

        def out():
            w, v, kind = (np.concatenate(x) for x in zip(*held, strict=True))
            # an eighth of the words at a time: batches and what they take to make stay small
            for null, by in ((False, w), (True, v)):
                for part in range(8):
                    own = by >> np.uint64(61) == part
                    if own.any():
                        yield table(by[own], v[own], kind[own], null)

        for b in batches:
            toxic, fold = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
            for a, _, h, row in _words(b.column(0)):
                if len(h):
                    held.append((h, _before(h, row), (toxic[a + row] * 2 + fold[a + row]).astype(np.int8)))
                    n += len(h)
                if n > HELD:
                    yield from out()
                    held, n = [], 0
        if held:
            yield from out()

    rows = labelled.mapInArrow(run, schema)
    parts = max(1, int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "w").groupBy("w", "v").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in ("00", "01", "10", "11")))


def _of(model: str, y: int):
    """Count of class y in a model's rows."""
    return {"all": F.col(f"c{y}0") + F.col(f"c{y}1"), "not0": F.col(f"c{y}1"), "not1": F.col(f"c{y}0")}[model]


def _discount(n1, n2):
    """Kneser and Ney's estimate from the numbers of entries seen once and twice."""
    return float(n1) / (n1 + 2 * n2) if n1 else 0.5


@dataclass
class Tables:
    """The model's entries: words (w, x_*, l_*), where x is the continuation order's log ratio and l that of what the word leaves to it as a history; pairs (w, v, e_*), what seeing the pair adds to both."""

    words: DataFrame
    pairs: DataFrame
    #: Log ratio of a word that is not in words, for each of MODELS.
    unknown: list[float]


def fit(counted: DataFrame, whole: bool = False) -> Tables | None:
    """The models of counts, of all pairs and words or pruned; None unless both classes were seen."""
    both = [(m, y) for m in MODELS for y in (0, 1)]
    seen = F.col("v").isNotNull()
    kept = seen if whole else seen & (F.col("c10") + F.col("c11") > 0) & (F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11") > 1)
    stored = common.checkpointed(counted)
    # a pair gives its word a context; the counts of a history are its word's
    contexts = [F.count_if(seen & (_of(m, y) > 0)).alias(f"n_{m}{y}") for m, y in both]
    word = common.checkpointed(stored.groupBy("w").agg(*contexts, *(F.coalesce(F.sum(F.when(~seen, F.col(f"c{k}"))), F.lit(0)).alias(f"c{k}") for k in ("00", "01", "10", "11"))))
    pairs = stored.where(kept)
    total = word.agg(F.count("*").alias("words"), *(F.coalesce(f(n), F.lit(0)).alias(f"{k}_{n[2:]}") for n in (f"n_{m}{y}" for m, y in both) for k, f in (("sum", F.sum), ("one", lambda n: F.count_if(F.col(n) == 1)), ("two", lambda n: F.count_if(F.col(n) == 2)), ("any", lambda n: F.count_if(F.col(n) > 0))))).first()
    once = pairs.agg(*(F.count_if(_of(m, y) == k).alias(f"{m}{y}{k}") for m, y in both for k in (1, 2))).first()
    if not (total["sum_all0"] and total["sum_all1"]):
        return None
    columns, history, unknown = [], [], []
    for m in MODELS:
        size = total[f"sum_{m}0"] + total[f"sum_{m}1"]
        shared = (F.col(f"n_{m}0") + F.col(f"n_{m}1") + 0.5) / (size + 0.5 * total["words"])
        left = []
        for y in (0, 1):
            d, n = _discount(total[f"one_{m}{y}"], total[f"two_{m}{y}"]), max(1, total[f"sum_{m}{y}"])
            # what the discount takes of a class's contexts goes to the shared counts
            left.append(d * total[f"any_{m}{y}"] / n if total[f"sum_{m}{y}"] else 1.0)
            columns.append((F.greatest(F.col(f"n_{m}{y}") - d, F.lit(0.0)) / n + left[y] * shared).alias(f"p_{m}{y}"))
            history.append(_of(m, y).alias(f"h_{m}{y}"))
        unknown.append(float(np.log(left[1] / left[0])))
    word = word.select("w", *columns, *history, (F.col("n_all0") + F.col("n_all1") > (0 if whole else 1)).alias("known"))
    top = [(F.greatest(_of(m, y) - _discount(once[f"{m}{y}1"], once[f"{m}{y}2"]), F.lit(0.0)) / F.greatest(F.col(f"h_{m}{y}"), F.lit(1))).alias(f"t_{m}{y}") for m, y in both]
    before = word.select(F.col("w").alias("v"), *(f"h_{m}{y}" for m, y in both))
    pairs = pairs.join(before, "v").select("w", "v", *top)
    used = pairs.groupBy("v").agg(*(F.sum(f"t_{m}{y}").alias(f"u_{m}{y}") for m, y in both))
    left = used.select("v", *(F.greatest(F.lit(1e-6), 1 - F.col(f"u_{m}{y}")).alias(f"l_{m}{y}") for m, y in both))
    pairs = pairs.join(left, "v").join(word.select("w", "known", *(f"p_{m}{y}" for m, y in both)), "w")
    low = [F.when(F.col("known"), F.log(F.col(f"p_{m}1") / F.col(f"p_{m}0"))).otherwise(u) + F.log(F.col(f"l_{m}1") / F.col(f"l_{m}0")) for m, u in zip(MODELS, unknown, strict=True)]
    more = [(F.log((F.col(f"t_{m}1") + F.col(f"l_{m}1") * F.col(f"p_{m}1")) / (F.col(f"t_{m}0") + F.col(f"l_{m}0") * F.col(f"p_{m}0"))) - base).cast("float").alias(f"e_{m}") for m, base in zip(MODELS, low, strict=True)]
    words = word.join(left.withColumnRenamed("v", "w"), "w", "left").where("known or l_all0 is not null")
    x = [F.when(F.col("known"), F.log(F.col(f"p_{m}1") / F.col(f"p_{m}0"))).otherwise(u).cast("float").alias(f"x_{m}") for m, u in zip(MODELS, unknown, strict=True)]
    back = [F.coalesce(F.log(F.col(f"l_{m}1") / F.col(f"l_{m}0")), F.lit(0.0)).cast("float").alias(f"l_{m}") for m in MODELS]
    return Tables(common.checkpointed(words.select("w", *x, *back)), common.checkpointed(pairs.select("w", "v", *more)), unknown)


class Model:
    """The entries of some models, by hash."""

    def __init__(self, tables: Tables, models: tuple[int, ...], pairs: bool = True):
        words, pairs = tables.words.toArrow(), (tables.pairs if pairs else tables.pairs.limit(0)).toArrow()
        w = words.column("w").to_numpy().view(np.uint64)
        order = np.argsort(w)
        self.words, self.models = w[order], models
        self.x = [words.column(f"x_{MODELS[m]}").to_numpy()[order] for m in models]
        self.left = [words.column(f"l_{MODELS[m]}").to_numpy()[order] for m in models]
        key = pair_keys(pairs.column("v").to_numpy().view(np.uint64), pairs.column("w").to_numpy().view(np.uint64))
        order = np.argsort(key)
        self.pairs = key[order]
        self.more = [pairs.column(f"e_{MODELS[m]}").to_numpy()[order] for m in models]
        self.unknown = [tables.unknown[m] for m in models]

    @staticmethod
    def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each asked key, and whether it is there."""
        if not len(keys):
            return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return at, keys[at] == asked

    def ratios(self, h: np.ndarray, row: np.ndarray, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Log ratio of each word under the whole model and under the continuation order; k: which of the models."""
        word, of = np.unique(h, return_inverse=True)
        at, there = self._find(self.words, word)
        x = (np.where(there, self.x[k][at], self.unknown[k]) if len(self.words) else np.full(len(word), self.unknown[k]))[of]
        before = _before(h, row)
        began, had = self._find(self.words, np.append(word, START))
        left = np.where(had, self.left[k][began], 0.0) if len(self.words) else np.zeros(len(word) + 1)
        place = np.concatenate(([len(word)], of[:-1])) if len(of) else of
        place = np.where(before == START, len(word), place)
        whole = x + left[place]
        asked = np.flatnonzero(had[place])
        found, hit = self._find(self.pairs, pair_keys(before[asked], h[asked]))
        if len(self.pairs):
            whole[asked[hit]] += self.more[k][found[hit]]
        return whole, x

    def features(self, column: pa.Array, k: int = 0) -> np.ndarray:
        out = np.zeros((len(column), 2 + len(SPANS)))
        for a, b, h, row in _words(column):
            if len(h):
                out[a:b] = pooled(*self.ratios(h, row, k), row, b - a)
        return out


def pooled(whole: np.ndarray, x: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Features of so many rows from the ratios of their words (in the order of rows)."""
    out = np.zeros((rows, 2 + len(SPANS)))
    n = np.bincount(row, minlength=rows)
    starts, has = np.concatenate(([0], np.cumsum(n)))[:-1], n > 0
    total = np.bincount(row, weights=whole, minlength=rows)
    out[:, 0] = total / np.maximum(1, n)
    out[:, 1] = total / np.sqrt(np.maximum(1, n))
    sums = np.concatenate(([0], np.cumsum(x, dtype=np.float64)))
    end = np.arange(1, len(x) + 1)
    for k, w in enumerate(SPANS):
        begin = np.maximum(end - w, starts[row])
        out[has, 2 + k] = np.maximum.reduceat((sums[end] - sums[begin]) / w, starts[has])
    return out


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method on standardised features: (mean, scale, weights with the constant last)."""
    mean, scale = x.mean(axis=0), np.maximum(1e-9, x.std(axis=0))
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.diag([1.0] * (z.shape[1] - 1) + [0.01])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return mean, scale, w


def _paired_features(docs: DataFrame, tables: Tables, model: int, text: str, keep: tuple[str, ...]) -> DataFrame:
    """Columns ``keep`` and x, the features, where only the words are broadcast: a text's pairs, one hash each, are joined with the model's."""
    rows, held = docs.select(*keep, F.xxhash64(text).alias("_key"), F.col(text).alias("_text")), len(keep)
    shared = docs.sparkSession.sparkContext.broadcast(vars(Model(tables, (model,), pairs=False)))

    def base(batches):
        words = common.revived(Model, shared.value)
        for b in batches:
            x, n = np.zeros((b.num_rows, 2 + len(SPANS))), np.zeros(b.num_rows, np.int64)
            for a, e, h, row in _words(b.column(held + 1)):
                if len(h):
                    x[a:e], n[a:e] = pooled(*words.ratios(h, row), row, e - a), np.bincount(row, minlength=e - a)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(held + 1)), pa.array(n), pa.array(list(x), pa.list_(pa.float64()))], names=[*b.schema.names[: held + 1], "_n", "x"])

    def met(batches):
        words = common.revived(Model, shared.value)
        for b in batches:
            keys = b.column(0).to_numpy()
            for a, _, h, row in _words(b.column(1)):
                v = _before(h, row)
                told = np.flatnonzero(words._find(words.words, v)[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys[a + row[told]]), pa.array(h[told].view(np.int64)), pa.array(v[told].view(np.int64))], names=["_key", "w", "v"])

    pair = F.xxhash64("v", "w").alias("pair")
    found = rows.select("_key", "_text").mapInArrow(met, "_key long, w long, v long").select("_key", pair)
    found = found.join(tables.pairs.select(pair, F.col(f"e_{MODELS[model]}").cast("double").alias("e")), "pair").groupBy("_key").agg(F.sum("e").alias("e"))
    found = found.join(rows.groupBy("_key").agg(F.count("*").alias("copies")), "_key").select("_key", (F.col("e") / F.col("copies")).alias("e"))
    out = rows.mapInArrow(base, rows.drop("_text").schema.add("_n", "long").add("x", T.ArrayType(T.DoubleType()))).join(found, "_key", "left")
    e, n = F.coalesce("e", F.lit(0.0)), F.greatest("_n", F.lit(1))
    return out.select(*keep, F.concat(F.array(F.col("x")[0] + e / n, F.col("x")[1] + e / F.sqrt(n)), F.slice("x", 3, len(SPANS))).alias("x"))


def _joined_features(docs: DataFrame, tables: Tables, model: int, text: str, keep: tuple[str, ...], broadcast: int = BROADCAST) -> DataFrame:
    """Columns ``keep`` and x, the features, where the model is too large to broadcast: tokens are joined with its tables."""
    if tables.words.count() <= broadcast:
        return _paired_features(docs, tables, model, text, keep)
    m = MODELS[model]
    rows = docs.select(*keep, F.col(text).alias("_text"), F.xxhash64(text).alias("_key"))

    def run(batches):
        for b in batches:
            keys = b.column(1).to_numpy()
            for a, _, h, row in _words(b.column(0)):
                place = np.arange(len(h)) - np.searchsorted(row, row)
                yield pa.RecordBatch.from_arrays([pa.array(keys[a + row]), pa.array(place), pa.array(h.view(np.int64)), pa.array(_before(h, row).view(np.int64))], names=["key", "place", "w", "v"])

    texts = rows.select("_text", "_key").dropDuplicates(["_key"])
    found = texts.mapInArrow(run, "key long, place long, w long, v long")
    found = found.join(tables.words.select("w", F.col(f"x_{m}").alias("x")), "w", "left")
    found = found.join(tables.words.select(F.col("w").alias("v"), F.col(f"l_{m}").alias("l")), "v", "left")
    found = found.join(tables.pairs.select("w", "v", F.col(f"e_{m}").alias("e")), ["w", "v"], "left")
    x = F.coalesce("x", F.lit(tables.unknown[model]).cast("float"))
    none = F.lit(0.0).cast("float")
    found = found.select("key", F.struct("place", x.alias("x"), (x + F.coalesce("l", none) + F.coalesce("e", none)).alias("whole")).alias("t"))
    found = found.groupBy("key").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def pool(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                t = b.column(1)[i].values
                x, whole = (t.field(c).to_numpy().astype(np.float64) for c in (1, 2))
                out.append(pooled(whole, x, np.zeros(len(x), np.int64), 1)[0])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], names=["_key", "x"])

    got = found.mapInArrow(pool, "_key long, x array<double>")
    none = F.array(*(F.lit(0.0) for _ in range(2 + len(SPANS))))
    return rows.drop("_text").join(got, "_key", "left").withColumn("x", F.coalesce("x", none)).drop("_key")


def train(docs: DataFrame, labels: DataFrame, curve_rows: int = CURVE_ROWS, broadcast: int = BROADCAST):
    """(Model or Tables of all labelled rows, curve) from docs (doc_id, text) and labels (doc_id, toxic); (constant, None) without both classes."""
    spark = docs.sparkSession
    labels = labels.where("toxic in (0, 1)").select("doc_id", "toxic")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold")
    rows = common.joined_labels(docs.select("doc_id", "text"), labels)
    tables = fit(counts(rows.select("text", F.col("toxic").cast("int").alias("toxic"), fold)), whole=True)
    common.release(docs)
    sample = docs.select("doc_id", "text").join(F.broadcast(common.label_sample(labels, curve_rows)), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), fold)
    if tables is None:
        return float(bool(labels.where("toxic = 1").limit(1).count()) and not labels.where("toxic = 0").limit(1).count()), None
    if tables.words.count() + tables.pairs.count() > broadcast:
        parts = [_joined_features(sample.where(F.col("fold") == k), tables, 1 + k, "text", ("toxic",)) for k in (0, 1)]
        got = parts[0].unionByName(parts[1]).toPandas()
        return tables, _curve(np.stack(got["x"]), got["toxic"].to_numpy(float))
    halves = spark.sparkContext.broadcast(vars(Model(tables, (1, 2))))

    def score(batches):
        model = common.revived(Model, halves.value)
        for b in batches:
            fold = b.column(2).to_numpy(zero_copy_only=False)
            x = np.where((fold == 0)[:, None], model.features(b.column(0), 0), model.features(b.column(0), 1))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1)], names=["x", "toxic"])

    got = sample.mapInArrow(score, "x array<double>, toxic int").toPandas()
    halves.unpersist()
    return Model(tables, (0,)), _curve(np.stack(got["x"]), got["toxic"].to_numpy(float))


def _probability(x: np.ndarray, curve) -> np.ndarray:
    mean, scale, w = curve
    return 1 / (1 + np.exp(-np.clip((x - mean) / scale @ w[:-1] + w[-1], -30, 30)))


def score(docs: DataFrame, model, curve, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, then score."""
    held = len(keep)
    names = [*docs.select(*keep).columns, "score"]
    schema = docs.select(*keep).schema.add("score", "double")
    if isinstance(model, Tables):

        def told(batches):
            for b in batches:
                x = np.array(b.column(held).to_pylist(), float).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(held)), pa.array(_probability(x, curve) if len(x) else [], pa.float64())], names=names)

        return _joined_features(docs, model, 0, text, keep).mapInArrow(told, schema)
    shared = docs.sparkSession.sparkContext.broadcast((model if curve is None else vars(model), curve))

    def run(batches):
        state, curve = shared.value
        model = state if curve is None else common.revived(Model, state)
        for b in batches:
            p = np.full(b.num_rows, model) if curve is None else _probability(model.features(b.column(held)), curve)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(held)), pa.array(p, pa.float64())], names=names)

    return docs.select(*keep, F.col(text)).mapInArrow(run, schema)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers, the first ascending, in few bytes."""
    head, body = [len(columns)], []
    for i, c in enumerate(columns):
        if i == 0 and len(c):
            c = np.diff(c, prepend=c[:1] - c[:1])
        if c.dtype.kind == "u":
            c = c.astype(np.min_scalar_type(c.max() if len(c) else 0))
        head += [len(c), ord(c.dtype.kind), c.dtype.itemsize]
        body.append(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes())
    plain = np.array(head, np.int64).tobytes() + b"".join(body)
    return len(plain).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(plain, asbytes=True)


def _unpacked(blob: bytes, wide: bool = True) -> list[np.ndarray]:
    plain = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n = int(np.frombuffer(plain, np.int64, 1)[0])
    head, at, out = np.frombuffer(plain, np.int64, 3 * n, 8).reshape(n, 3), 8 + 24 * n, []
    for i, (rows, kind, width) in enumerate(head.tolist()):
        c = np.frombuffer(plain, np.uint8, rows * width, at).reshape(width, rows).T.copy().view(f"{chr(kind)}{width}").reshape(rows)
        at += rows * width
        c = c.astype(np.uint64) if chr(kind) == "u" and wide else c
        out.append(np.cumsum(c, dtype=np.uint64) if i == 0 else c)
    return out


def _summed(key: np.ndarray, columns) -> tuple[np.ndarray, list[np.ndarray]]:
    """A place of each distinct key, and the sums of columns over its rows."""
    order = np.argsort(key)
    first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1]))) if len(key) else order
    return order[first], [np.add.reduceat(c[order], first) if len(key) else c for c in columns]


def _dealt(by: np.ndarray, parts: int, *columns: np.ndarray):
    """(part, blob) for each part that some rows fall to by their hash; rows in the order of the first column."""
    part = ((by >> np.uint64(33)) % np.uint64(parts)).astype(np.min_scalar_type(parts))
    order = np.argsort(columns[0])
    order = order[np.argsort(part[order], kind="stable")]
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(ends)):
        own = order[ends[k] : ends[k + 1]]
        yield int(k), _packed(*(c[own] for c in columns))


def _joined(blobs) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*(_unpacked(x) for x in blobs), strict=True)]


def _by_model(c):
    """Counts of MODELS and classes, in that order, from those of classes and folds."""
    return [x for of in (lambda y: c[2 * y] + c[2 * y + 1], lambda y: c[2 * y + 1], lambda y: c[2 * y]) for x in (of(0), of(1))]


def _word_rows(rows: DataFrame, parts: int) -> DataFrame:
    """(blob, size, totals): words with their contexts, followers and counts as a history, from rows (text, k0, k1, fold) that stand for k0 ordinary and k1 toxic labelled rows.

    totals: the pairs seen once and twice, by model and class.  Counts travel packed; pairs are not stored.
    """

    def first(batches):
        held, n = [], 0

        def out():
            w, v, row, *kinds = (np.concatenate(x) for x in zip(*held, strict=True))
            at, sums = _summed(pair_keys(v, w), kinds)
            got = list(_dealt(w[at], parts, w[at], v[at], *sums))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary())], names=["part", "blob"])

        for b in batches:
            k0, k1, fold = (b.column(i).to_numpy(zero_copy_only=False).astype(np.uint64) for i in (1, 2, 3))
            for a, _, h, row in _words(b.column(0)):
                if len(h):
                    own = a + row
                    held.append((h, _before(h, row), own, *(k[own] * (fold[own] == f) for k in (k0, k1) for f in (0, 1))))
                    n += len(h)
                if n > HELD // 4:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    def pairs(batches):
        blobs = [x for b in batches for x in b.column(1).to_pylist()]
        if not blobs:
            return
        w, v, *c = _joined(blobs)
        at, c = _summed(pair_keys(v, w), c)
        w, v, seen = w[at], v[at], _by_model(c)
        totals = [int((x == k).sum()) for k in (1, 2) for x in seen]
        seen, none = [(x > 0).astype(np.uint32) for x in seen], np.zeros(len(at), np.uint32)
        word = np.concatenate((w, v))
        del blobs, at, w, v
        at, sums = _summed(word, (np.concatenate(x) for x in [*((x, none) for x in seen), *((none, x) for x in (*seen, *c))]))
        del seen, none, c
        got = list(_dealt(word[at], parts, word[at], *sums))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary()), pa.array([totals, *[None] * (len(got) - 1)], pa.list_(pa.int64()))], names=["part", "blob", "totals"])

    def words(batches):
        blobs, totals = [], np.zeros(12, np.int64)
        for b in batches:
            blobs += b.column(1).to_pylist()
            for x in b.column(2).to_pylist():
                totals += np.array(x if x else [0] * 12)
        if blobs:
            word, *c = _joined(blobs)
            at, c = _summed(word, c)
            yield pa.RecordBatch.from_arrays([pa.array([_packed(word[at], *c)], pa.binary()), pa.array([len(at)], pa.int64()), pa.array([totals.tolist()], pa.list_(pa.int64()))], names=["blob", "size", "totals"])

    out = rows.select("text", "k0", "k1", "fold").mapInArrow(first, "part int, blob binary").repartitionById(parts, "part").mapInArrow(pairs, "part int, blob binary, totals array<long>")
    return common.checkpointed(out.repartitionById(parts, "part").mapInArrow(words, "blob binary, size long, totals array<long>"))


def _word_model(stats: DataFrame) -> dict | None:
    """The words' part of the model, packed, for ``_opened``; None unless both classes were seen."""
    got = stats.collect()
    if not got:
        return None
    word, *c = (np.concatenate(x) for x in zip(*(_unpacked(bytes(r["blob"]), wide=False) for r in got), strict=True))
    totals = np.sum([r["totals"] for r in got], axis=0)
    del got
    order = np.argsort(word)
    sums = [int(n.sum(dtype=np.int64)) for n in c[:6]]
    if not (sums[0] and sums[1]):
        return None
    # of contexts: discount, their number, what the discount takes of it; of pairs: discount
    d = [_discount(int((n == 1).sum()), int((n == 2).sum())) for n in c[:6]]
    left = [d[k] * int((c[k] > 0).sum()) / sums[k] if sums[k] else 1.0 for k in range(6)]
    top = [_discount(int(totals[k]), int(totals[6 + k])) for k in range(6)]
    return {"packed": _packed(word[order], *(x[order] for x in c)), "d": d, "sums": sums, "lost": left, "top": top}


def _opened(state: dict, use: str) -> Model:
    """What of the words' model one use takes ("words", "pairs" or "ratios"), made once in a worker."""
    if state.get("use") != use:
        word, *c = _unpacked(state["packed"], wide=False)
        made = {"words": word, "d": state["top"], "models": (0, 1, 2), "pairs": np.zeros(0, np.uint64), "more": [np.zeros(0, np.float32)] * 3}
        if use != "words":
            h = _by_model([x.astype(np.uint64 if x.dtype.itemsize > 4 or x.max() >= 1 << 31 else np.uint32) for x in c[12:]])
            p, l = [], []
            for k in range(6):
                size, pair = max(1, state["sums"][k]), k // 2 * 2
                shared = (c[pair].astype(float) + c[pair + 1] + 0.5) / (state["sums"][pair] + state["sums"][pair + 1] + 0.5 * len(word))
                p.append((np.maximum(c[k] - state["d"][k], 0) / size + state["lost"][k] * shared).astype(np.float32))
                # a discount is one at most, so what it takes of a history is one for each follower
                l.append(np.maximum(1e-6, 1 - (h[k] - state["top"][k] * c[6 + k]) / np.maximum(1, h[k])).astype(np.float32))
            if use == "pairs":
                made |= {"words": None, "p": p, "l": l, "h": h}
            else:
                known, lost = (c[0] > 0) | (c[1] > 0), state["lost"]
                made["unknown"] = [float(np.log(lost[2 * m + 1] / lost[2 * m])) for m in range(3)]
                made["x"] = [np.where(known, np.log(p[2 * m + 1] / p[2 * m]), made["unknown"][m]).astype(np.float32) for m in range(3)]
                made["left"] = [np.log(l[2 * m + 1] / l[2 * m]).astype(np.float32) for m in range(3)]
        state |= {"use": use, "made": made}
    return common.revived(Model, state["made"])


def _pair_sums(rows: DataFrame, shared, parts: int, part: int, slices: int) -> DataFrame:
    """(key, e): what the pairs of a text that are in a slice of all pairs add to its ratio, from rows (text, k0, k1, fold, model, key).

    Every word of every text meets the others of its pair once, packed: their labels give the pair's
    counts, and these each text's entries, which go back to the block of texts they came from.
    """
    schema = "part int, block long, texts boolean, blob binary"

    def batch(got):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.bool_(), pa.binary()))], names=["part", "block", "texts", "blob"])

    def first(batches):
        from pyspark import TaskContext

        words, task, block = _opened(shared.value, "words"), TaskContext.get().partitionId() << 32, 0
        held, labels, keys, n, base = [], [], [], 0, 0

        def out():
            h, v, row = (np.concatenate(x) for x in zip(*held, strict=True))
            kinds, code = np.unique(np.concatenate(labels), axis=0, return_inverse=True)
            code = code.reshape(-1).astype(np.uint64)
            id = task + block
            got = [(int(id % parts), id, True, _packed(np.zeros(0, np.uint64), np.concatenate(keys).view(np.uint64)))]
            (w, of), (u, ov) = (np.unique(x, return_inverse=True) for x in (h, v))
            (at, there), (by, had) = words._find(words.words, w), words._find(words.words, u)
            told = there[of] & had[ov]
            row, key = row[told], (at[of[told]].astype(np.uint64) << np.uint64(32)) | by[ov[told]].astype(np.uint64)
            for k, blob in _dealt(common.mix(key), parts, key, row, code[row]):
                got.append((k, id, False, blob))
            # the labels that the codes stand for
            got.append((-1, id, False, _packed(np.zeros(0, np.uint64), *kinds.T)))
            return got

        def sent(got):
            kinds = got.pop()[3]
            size = len(kinds).to_bytes(8, "little")
            return batch([x if x[2] else (*x[:3], size + kinds + x[3]) for x in got])

        for b in batches:
            own = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.uint64) for i in (1, 2, 3, 4)], axis=1)
            for a, e, h, row in _words(b.column(0)):
                labels.append(own[a:e]), keys.append(b.column(5).to_numpy()[a:e])
                v = _before(h, row)
                mine = pair_keys(v, h) % np.uint64(slices) == part
                held.append((h[mine], v[mine], (base + row[mine]).astype(np.uint64)))
                base, n = base + e - a, n + int(mine.sum())
                if n > HELD // 4:
                    yield sent(out())
                    held, labels, keys, n, base, block = [], [], [], 0, 0, block + 1
        if held:
            yield sent(out())

    def met(batches):
        words = _opened(shared.value, "pairs")
        key, place, kind, kinds, blocks, most = [], [], [], [], [], 0
        for b in batches:
            texts = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if texts.any():
                yield b.filter(pa.array(texts))
            for i in np.flatnonzero(~texts):
                blob = b.column(3)[i].as_py()
                size = 8 + int.from_bytes(blob[:8], "little")
                k, row, code = _unpacked(blob[size:])
                table = np.stack(_unpacked(blob[8:size])[1:], axis=1)
                key.append(k), place.append(row | np.uint64(len(blocks) << 32)), kind.append(code + np.uint64(most))
                kinds.append(table), blocks.append(b.column(1)[i].as_py())
                most += len(table)
        if not key:
            return
        key, place, kind = (np.concatenate(x) for x in (key, place, kind))
        kinds, code = np.unique(np.concatenate(kinds), axis=0, return_inverse=True)
        kind = code.reshape(-1)[kind.astype(np.int64)]
        order = np.argsort(key)
        key, place, kind = key[order], place[order], kind[order].astype(np.int32)
        del order, code
        begins = np.concatenate(([True], key[1:] != key[:-1]))
        first, of = np.flatnonzero(begins), np.cumsum(begins) - 1
        c = [np.add.reduceat((kinds[:, y] * (kinds[:, 2] == f))[kind], first) for y in (0, 1) for f in (0, 1)]
        w, v = (key[first] >> np.uint64(32)).astype(np.int64), (key[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        by = _by_model(c)
        e = np.zeros(len(key), np.float64)
        for m in range(3):
            own = np.flatnonzero(kinds[kind, 3] == m)
            if len(own):
                low = [words.l[2 * m + y][v].astype(float) * words.p[2 * m + y][w] for y in (0, 1)]
                top = [np.maximum(by[2 * m + y] - words.d[2 * m + y], 0) / np.maximum(1, words.h[2 * m + y][v]) for y in (0, 1)]
                e[own] = np.log((top[1] + low[1]) / (top[0] + low[0]) * (low[0] / low[1]))[of[own]]
        del by, c, of, kind, key, w, v
        at, (e,) = _summed(place, [e])
        place = place[at]
        ends = np.searchsorted(place >> np.uint64(32), np.arange(len(blocks) + 1, dtype=np.uint64))
        got = []
        for i, id in enumerate(blocks):
            own = slice(ends[i], ends[i + 1])
            got.append((int(id % parts), id, False, _packed(place[own] & np.uint64(0xFFFFFFFF), e[own].astype(np.float32))))
        yield batch(got)

    def back(batches):
        keys, sums = {}, {}
        for b in batches:
            for id, texts, blob in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if texts:
                    keys[id] = _unpacked(blob)[1]
                else:
                    sums.setdefault(id, []).append(blob)
        for id, key in keys.items():
            e = np.zeros(len(key))
            for row, x in map(_unpacked, sums.pop(id, [])):
                e[row.astype(np.int64)] += x
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(e)], names=["key", "e"])

    out = rows.select("text", "k0", "k1", "fold", "model", "key").mapInArrow(first, schema).repartitionById(parts, "part")
    out = out.mapInArrow(met, schema).repartitionById(parts, "part").mapInArrow(back, "key long, e double")
    # texts that are alike have alike sums
    return common.checkpointed(out.groupBy("key").agg(F.max("e").alias("e")))


def _whole_features(rows: DataFrame, shared, sums: DataFrame, keep: tuple[str, ...], broadcast_rows: int = 2_000_000) -> DataFrame:
    """Columns ``keep`` and x, the features, of rows (keep, model, key, text)."""
    held = len(keep)

    def base(batches):
        words = _opened(shared.value, "ratios")
        for b in batches:
            model = b.column(held).to_numpy(zero_copy_only=False)
            x, n = np.zeros((b.num_rows, 2 + len(SPANS))), np.zeros(b.num_rows, np.int64)
            for a, e, h, row in _words(b.column(held + 2)):
                for m in np.unique(model[a:e]) if len(h) else ():
                    got, own = pooled(*words.ratios(h, row, m), row, e - a), model[a:e] == m
                    x[a:e][own] = got[own]
                n[a:e] = np.bincount(row, minlength=e - a)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(held)), b.column(held + 1), pa.array(n), pa.array(list(x), pa.list_(pa.float64()))], names=[*b.schema.names[:held], "_key", "_n", "_x"])

    rows = rows.select(*keep, F.col("model").alias("_model"), F.col("key").alias("_key"), F.col("text").alias("_text"))
    out = rows.mapInArrow(base, rows.select(*keep, "_key").schema.add("_n", "long").add("_x", T.ArrayType(T.DoubleType())))
    sums = sums.select(F.col("key").alias("_key"), F.col("e").alias("_e"))
    out = out.join(F.broadcast(sums) if sums.count() <= broadcast_rows else sums, "_key", "left")
    e, n = F.coalesce("_e", F.lit(0.0)), F.greatest("_n", F.lit(1))
    return out.select(*keep, F.concat(F.array(F.col("_x")[0] + e / n, F.col("_x")[1] + e / F.sqrt(n)), F.slice("_x", 3, len(SPANS))).alias("x"))


def scored(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), curve_rows: int = CURVE_ROWS, broadcast: int = BROADCAST, slices: int = SLICES) -> DataFrame:
    """Columns ``keep`` of docs (doc_id, text, ...), then score, learned from labels (doc_id, toxic): what ``train`` and ``score`` give, without a stored model.

    Pairs are counted and looked up in one exchange, a slice of them after the other, so that
    no table of them is stored; the words' part of the model is broadcast.  Each slice reads the texts anew.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    known = labels.where("toxic in (0, 1)").select("doc_id", "toxic")
    fold = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)), F.lit(0)).cast("int").alias("fold")
    by_doc = known.groupBy(F.col("doc_id").alias("_id")).agg(F.count_if(F.col("toxic") == 0).alias("k0"), F.count_if(F.col("toxic") == 1).alias("k1"))
    by_doc = common.checkpointed(by_doc)
    few = by_doc.count() <= 2_000_000
    key = lambda m: F.xxhash64("text", m).alias("key")
    one = docs.join(F.broadcast(by_doc) if few else by_doc, F.col("doc_id") == F.col("_id"), "left")
    one = one.select("text", *(F.coalesce(k, F.lit(0)).alias(k) for k in ("k0", "k1")), fold, F.lit(0).alias("model"), key(F.lit(0)))
    stats = _word_rows(one.where("k0 + k1 > 0"), parts)
    common.release(docs)
    size = stats.agg(F.sum("size")).first()[0] or 0
    state = _word_model(stats) if size <= broadcast else None
    if state is None:
        model, curve = train(docs.select("doc_id", "text"), labels, curve_rows, broadcast)
        return score(docs, model, curve, keep=keep)
    shared = docs.sparkSession.sparkContext.broadcast(state)
    del state
    sample = docs.select("doc_id", "text").join(F.broadcast(common.label_sample(known, curve_rows)), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), (fold + 1).alias("model"))
    sample = sample.select("toxic", "text", "model", key(F.col("model")))
    both = one.unionByName(sample.select("text", *(F.lit(0).cast("long").alias(k) for k in ("k0", "k1")), F.lit(0).alias("fold"), "model", "key"))
    sums = None
    for part in range(slices):
        more = _pair_sums(both, shared, parts, part, slices)
        sums = more if sums is None else common.checkpointed(sums.unionByName(more).groupBy("key").agg(F.sum("e").alias("e")))
        del more
        common.release(docs)
    got = _whole_features(sample, shared, sums, ("toxic",)).toPandas()
    curve = _curve(np.stack(got["x"]), got["toxic"].to_numpy(float))
    own = [F.col(c) for c in keep]
    found = _whole_features(docs.select(*own, "text", F.lit(0).alias("model"), key(F.lit(0))), shared, sums, keep)
    mean, scale, w = (x.tolist() for x in curve)
    z = sum((F.lit(w[i] / scale[i]) * (F.col("x")[i] - mean[i]) for i in range(len(mean))), F.lit(w[-1]))
    return found.select(*keep, (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("score"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    out = common.held_out("doc_id", 5, 0)
    found = scored(docs.select("doc_id", out.alias("held_out"), "text"), labels.where(~out), keep=("doc_id", "held_out"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
