"""Quality classifier: random-indexing word vectors, a two-layer network, temperature calibration.

Tokens are runs of lower-case, upper-case, digit and punctuation bytes.  Each
token has a sparse random index vector; its word vector adds the index vectors
of its neighbours over the whole corpus (hashed vocabulary, so the table has a
fixed size).  A document is the mean, spread and maximum of its tokens' vectors.
A two-layer network is trained on a bounded sample of labelled rows, and a
temperature fitted on rows it did not see calibrates its probabilities.

Defined cases: null and empty texts pool to zeros and get the network's score of
that; null labels are not learned; with no labelled row every score is 0.5, with
one class the score is that class; repeated rows are scored each; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOCAB, DIM, REACH = 1 << 14, 32, 2
#: Labelled rows at most on which the network is fitted, and of those the share for calibration.
FIT_ROWS, CALIBRATION = 20_000, 0.2
HIDDEN, EPOCHS, THRESHOLD = 32, 30, 0.3


def _tokens(column: pa.Array):
    data, offsets = common.arrow_bytes(column)
    classes = common.run_classes()
    for a, b in common.blocks(offsets):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        s, e, row = common.tokens(part, own, classes)
        h = common.token_hashes(part, s, e)
        yield a, b, (h % np.uint64(VOCAB)).astype(np.int64), h, row


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """(VOCAB, DIM) unit vectors from the neighbours within REACH tokens, over all rows."""

    def partial(batches):
        cells = np.zeros(VOCAB * DIM, np.float64)
        for b in batches:
            for _, _, word, h, row in _tokens(b.column(0)):
                index = [((h >> np.uint64(s)) % np.uint64(DIM)).astype(np.int64) for s in (20, 30)]
                sign = [np.where((h >> np.uint64(s)) & np.uint64(1), 1.0, -1.0) for s in (40, 41)]
                for gap in range(1, REACH + 1):
                    same = row[gap:] == row[:-gap]
                    for me, other in ((slice(None, -gap), slice(gap, None)), (slice(gap, None), slice(None, -gap))):
                        for i, v in zip(index, sign, strict=True):
                            cells += np.bincount((word[me] * DIM + i[other])[same], v[other][same], VOCAB * DIM)
        return cells

    cells = common.summed_tables(docs.select(text), partial, VOCAB * DIM).reshape(VOCAB, DIM)
    size = np.linalg.norm(cells, axis=1, keepdims=True)
    return (cells / np.maximum(size, 1e-9)).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean, spread and maximum of the token vectors of each row, and the log of the token count."""
    out = np.zeros((len(column), 3 * DIM + 1), np.float32)
    for a, b, word, _, row in _tokens(column):
        n = np.bincount(row, minlength=b - a)
        has = np.flatnonzero(n)
        if not len(has):
            continue
        starts = np.concatenate(([0], np.cumsum(n)))[:-1][has]
        # a few columns at a time keeps the gathered vectors small
        count = n[has].astype(np.float32)
        for c in range(0, DIM, 8):
            v = vectors[:, c : c + 8][word]
            mean = np.add.reduceat(v, starts, axis=0, dtype=np.float64) / count[:, None]
            square = np.add.reduceat(v * v, starts, axis=0, dtype=np.float64) / count[:, None]
            out[a + has, c : c + 8] = mean
            out[a + has, DIM + c : DIM + c + 8] = np.sqrt(np.maximum(0, square - mean * mean))
            out[a + has, 2 * DIM + c : 2 * DIM + c + 8] = np.maximum.reduceat(v, starts, axis=0)
        out[a + has, 3 * DIM] = np.log1p(count)
    return out


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 7) -> dict:
    """Two layers (tanh, logistic) by Adam, then the temperature that fits the calibration rows best."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    x, y = x[order].astype(np.float64), y[order].astype(np.float64)
    mean, scale = x.mean(axis=0), np.maximum(1e-3, x.std(axis=0))
    x -= mean
    x /= scale
    np.clip(x, -8, 8, out=x)
    cut = max(1, int(len(x) * CALIBRATION)) if len(x) > 20 else 0
    held, held_y, x, y = x[:cut], y[:cut], x[cut:], y[cut:]
    p = {"a": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "d": np.zeros(1)}
    m, v, step = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}, 0
    for epoch in range(EPOCHS):
        rate = 3e-3 * (1 - epoch / EPOCHS) + 1e-4
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            hidden = np.tanh(x[at] @ p["a"] + p["b"])
            off = (1 / (1 + np.exp(-np.clip(hidden @ p["c"] + p["d"], -30, 30))) - y[at]) / len(at)
            back = off[:, None] * p["c"] * (1 - hidden**2)
            grads = {"a": x[at].T @ back + 1e-4 * p["a"], "b": back.sum(axis=0), "c": hidden.T @ off + 1e-4 * p["c"], "d": off.sum(keepdims=True)}
            step += 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    t = 1.0
    if cut:
        z = np.tanh(held @ p["a"] + p["b"]) @ p["c"] + p["d"]
        tries = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        t = float(tries[np.argmin([np.mean(np.logaddexp(0, -np.where(held_y == 1, 1, -1) * z / k)) for k in tries])])
    return p | {"mean": mean, "scale": scale, "t": t}


def probability(x: np.ndarray, net: dict) -> np.ndarray:
    z = np.clip((x - net["mean"]) / net["scale"], -8, 8)
    z = (np.tanh(z @ net["a"] + net["b"]) @ net["c"] + net["d"]) / net["t"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS):
    """(word vectors, network or a constant) from docs (doc_id, text) and labels (doc_id, quality)."""
    vectors = word_vectors(docs)
    common.release(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    sample = common.label_sample(labels.where("quality in (0, 1)").select("doc_id", "quality"), fit_rows)

    def run(batches):
        for b in batches:
            x, y = pooled(b.column(0), shared.value), b.column(1).to_numpy(zero_copy_only=False).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["x", "y"])

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", F.col("quality").cast("int").alias("y"))
    # packed by batch: in an array each number would be an object in the driver's JVM and again in its Python
    got = rows.select("text", "y").mapInArrow(run, "x binary, y binary").collect()
    x = np.frombuffer(b"".join(r["x"] for r in got), np.float32).reshape(-1, 3 * DIM + 1)
    y = np.frombuffer(b"".join(r["y"] for r in got), np.int8)
    del got
    if not len(y):
        return vectors, 0.5
    order = np.lexsort((*x.T[:8], y))  # the same rows in the same order whatever the partitions
    return vectors, fit_network(x[order], y[order]) if len(set(y.tolist())) == 2 else float(y[0])


def score(docs: DataFrame, vectors: np.ndarray, net, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, then score."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))
    held = len(keep)
    names = [*docs.select(*keep).columns, "score"]

    def run(batches):
        vectors, net = shared.value
        for b in batches:
            p = np.full(b.num_rows, net) if isinstance(net, float) else probability(pooled(b.column(held), vectors), net)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(held)), pa.array(p, pa.float64())], names=names)

    return docs.select(*keep, F.col(text)).mapInArrow(run, docs.select(*keep).schema.add("score", "double"))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "quality")
    out = common.held_out("doc_id", 5, 0)
    vectors, net = train(docs, labels.where(~out))
    scored = score(docs.select("doc_id", out.alias("held_out"), "text"), vectors, net, keep=("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
