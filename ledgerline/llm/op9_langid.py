"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector.  A letter trigram is the elementwise
product of its letters' vectors, rotated by place; a document bundles (adds) the
vectors of its trigrams, scaled to unit length; a language's prototype bundles
its documents.  A document takes the language of the prototype with the largest
cosine, after the mean prototype is taken from both sides.

Defined cases: a null text or one without a letter gives ``und`` and score 0;
ties go to the smaller language; repeated rows are learned and predicted each;
rows without ``lang`` are predicted, not learned; with no learned language all
rows are ``und``; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DIM = 512
#: Languages whose prototypes (DIM doubles each) are held at once; a column with more values is no language column and is refused.
MAX_LANGUAGES = 4096
#: Letters of a text that are worked on at once.
PIECE = 1 << 19


def _letters() -> np.ndarray:
    """1 for each code point that is a letter."""
    global _LETTER
    try:
        return _LETTER
    except NameError:
        _LETTER = np.array([chr(i).isalpha() for i in range(0x110000)], bool)
        return _LETTER


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter trigrams (three 21-bit code points) of a text, blanks around words, and counts."""
    is_letter, text = _letters(), text.lower()
    kept, seen = np.full(1, 32, np.int64), []
    for at in range(0, max(1, len(text)), PIECE):
        code = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        code = np.concatenate((kept, np.where(is_letter[code], code, 32), [32] if at + PIECE >= len(text) else []))
        code = code[np.concatenate(([True], (code[1:] != 32) | (code[:-1] != 32)))].astype(np.int64)
        gram = (code[:-2] << 42) | (code[1:-1] << 21) | code[2:]
        seen.append(np.unique(gram[code[1:-1] != 32], return_counts=True))
        kept = code[-2:]  # the next piece goes on from here
    gram, of = np.unique(np.concatenate([g for g, _ in seen]), return_inverse=True)
    return gram, np.bincount(of, np.concatenate([n for _, n in seen]), len(gram)).astype(np.int64)


def _letter_vectors(codes: np.ndarray, dim: int) -> np.ndarray:
    lanes = np.arange(dim // 64, dtype=np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        words = common.mix(common.mix(codes.astype(np.uint64)[:, None] + np.uint64(77)) + lanes * common.BASE)
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1)
    return (bits.astype(np.int8) * 2 - 1).astype(np.int8)


class Encoder:
    """Trigram vectors, kept between batches up to a fixed number."""

    def __init__(self, dim: int, keep: int = 60_000):
        self.dim, self.keep = dim, keep
        self.known, self.vectors = np.zeros(0, np.int64), np.zeros((0, dim), np.int8)

    def _make(self, grams: np.ndarray) -> np.ndarray:
        mask = (1 << 21) - 1
        a, b, c = (_letter_vectors((grams >> s) & mask, self.dim) for s in (42, 21, 0))
        return np.roll(a, 2, axis=1) * np.roll(b, 1, axis=1) * c

    def rows(self, grams: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, grams)
        new = (at >= len(self.known)) | (self.known[np.minimum(at, max(0, len(self.known) - 1))] != grams) if len(self.known) else np.ones(len(grams), bool)
        if new.any():
            fresh = grams[new]
            if len(self.known) + len(fresh) > self.keep:
                self.known, self.vectors = grams, self._make(grams)
            else:
                known = np.concatenate((self.known, fresh))
                order = np.argsort(known, kind="stable")
                self.known, self.vectors = known[order], np.concatenate((self.vectors, self._make(fresh)))[order]
            at = np.searchsorted(self.known, grams)
        return self.vectors[at]

    def encode(self, text: str | None) -> np.ndarray | None:
        if not text:
            return None
        grams, n = _grams(text)
        if not len(grams):
            return None
        total = np.zeros(self.dim, np.float32)
        for at in range(0, len(grams), 20_000):
            total += n[at : at + 20_000].astype(np.float32) @ self.rows(grams[at : at + 20_000]).astype(np.float32)
        size = float(np.sqrt(total @ total))
        return total / size if size else total


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM) -> dict[str, np.ndarray]:
    """Prototype of each language over all given rows; partial bundles are added on executors."""

    def bundle(batches):
        enc, sums = Encoder(dim), {}
        for b in batches:
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = enc.encode(t)
                if v is not None:
                    sums[k] = sums.get(k, 0) + v.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "sums": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})

    parts = docs.select(F.col(text), F.col(lang)).where(F.col(lang).isNotNull()).mapInArrow(bundle, "lang string, sums array<double>")
    cells = parts.select("lang", F.posexplode("sums").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = cells.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; pass a coarser lang column")
    return {r["lang"]: np.array([c["x"] for c in r["v"]]) for r in rows}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",), dim: int = DIM) -> DataFrame:
    """Columns ``keep``, then lang_pred and score (0 to 1: half of one plus the cosine)."""
    names = sorted(prototypes)
    held = [f.name for f in docs.select(*keep).schema.fields]
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    if names:
        p = np.stack([prototypes[k] / max(1e-12, np.linalg.norm(prototypes[k])) for k in names])
        mean = p.mean(axis=0) if len(names) > 1 else np.zeros(dim)
        p = p - mean
        p = (p / np.maximum(1e-12, np.linalg.norm(p, axis=1))[:, None]).astype(np.float32)
        mean = mean.astype(np.float32)

    def run(batches):
        enc = Encoder(dim)
        for b in batches:
            lang, score = [], []
            for t in b.column(len(held)).to_pylist():
                v = enc.encode(t) if names else None
                if v is None:
                    lang.append("und"), score.append(0.0)
                    continue
                v = v - mean
                cos = p @ v / max(1e-12, float(np.sqrt(v @ v)))
                k = int(np.argmax(cos))
                lang.append(names[k]), score.append(float(min(1.0, max(0.0, 0.5 + cos[k] / 2))))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(held))), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*held, "lang_pred", "score"])

    return docs.select(*keep, F.col(text)).mapInArrow(run, schema)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = common.held_out("doc_id", 4, 2)
    learned = profiles(docs.where(~out))
    return predict(docs.select("doc_id", out.alias("held_out"), "text"), learned, keep=("doc_id", "held_out"))
