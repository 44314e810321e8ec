"""The pipeline's stages on a small folder of tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import op10_decontam

from test_exact import brute_spans, groups

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["th", "er", "ing", "re", "st", "ou"]) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(120):
        t = " ".join(word() for _ in range(60))
        rows.append([i, t if i % 4 else t.upper().replace(" ", "!! "), "en", f"s{i % 3}", len(t), 0.0])
    item = " ".join(f"item{k}" for k in range(20))
    rows[5][1] += " " + item
    rows[6][1] += " mail a.b1@mail.example.com now"
    rows.append([200, rows[7][1] + " x", "en", "s0", 1, 0.0])
    rows += [[201, None, None, None, None, None], [202, "", None, None, None, None], list(rows[9])]
    spark.createDataFrame([tuple(r) for r in rows], COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages_take_effect(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    quality, near, clean, pii, packed = seen.values()
    assert sum(i % 4 == 0 for i in quality if i < 120) <= 3 and sum(i % 4 > 0 for i in quality if i < 120) >= 88
    assert 200 not in near and near.count(9) == 1 and 7 in near
    assert set(near) - set(clean) == {5} and sorted(pii) == sorted(clean)
    assert set(packed) == {i for i in pii if i not in (201, 202)}
    redacted = spark.read.parquet(str(tmp_path / "3")).where(F.col("doc_id") == 6).first()
    assert "<EMAIL>" in redacted.text and redacted.n_chars == len(redacted.text)


def test_stages_against_brute_force(spark, folder):
    """Near-duplicate, decontamination and personal-data stages keep and change the rows that plain loops do."""
    rng = random.Random(9)
    words = [f"v{k}" for k in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(6)]
    item = " ".join(f"item{k}" for k in range(20))
    rows = []
    for i in range(60):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 2, 4, 9])):
            w[rng.randrange(80)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w) + (" " + " ".join(item.split()[: rng.choice([8, 11, 14, 20])]) if i % 7 == 0 else "") + (" call +1 555 123 4567 or a.b@c.org" if i % 5 == 0 else ""), "en", "s", 1, 0.0))
    docs = spark.createDataFrame(rows, COLUMNS)
    component = {doc: c for doc, _, c, _ in groups([r[:2] for r in rows], 5, 80)}
    near = corpus_pipeline.near_duplicates(spark, docs, folder)
    assert sorted(r.doc_id for r in near.collect()) == sorted({min(d for d in component if component[d] == c) for c in component.values()})

    def contaminated(text):
        d, b = text.split(), item.split()
        return any(sum(0 <= s + i < len(d) and d[s + i] == b[k + i] for i in range(13)) >= 11 for s in range(-2, len(d) - 10) for k in range(len(b) - 12))

    clean = corpus_pipeline.decontamination(spark, docs, folder)
    assert sorted(r.doc_id for r in clean.collect()) == [r[0] for r in rows if not contaminated(r[1])]
    for r in corpus_pipeline.personal_data(spark, docs, folder).collect():
        want = rows[r.doc_id][1]
        base_spans = brute_spans(want)
        assert all(want[a:b] not in r.text for _, a, b in base_spans) and (base_spans or r.text == want) and r.n_chars == len(r.text)
        assert r.text.count("<PHONE>") == sum(k == 3 for k, _, _ in base_spans) and r.text.count("<EMAIL>") == sum(k == 0 for k, _, _ in base_spans)


def test_rows_are_judged_each_by_its_text(spark, folder):
    """Rows without an id and rows that share one don't fall with another row."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    item = " ".join(f"item{k}" for k in range(20))
    rows = [(1, text(1)), (None, text(1)), (None, text(2)), (None, text(3) + " y"), (None, text(3)), (2, text(4)), (2, text(1) + " x"), (3, text(4) + " z")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.0) for i, t in rows], COLUMNS)
    near = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect()]
    assert len(near) == 4 and {(1, text(1)), (None, text(2)), (2, text(4))} < set(near) and {rows[3], rows[4]} & set(near)
    rows = [(None, text(5)), (None, text(6) + " " + item), (4, text(7)), (4, item + " " + text(8)), (5, text(9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (None, text(9))], "item_id long, text string")
    assert {tuple(r) for r in op10_decontam.clean(docs, items).collect()} == {rows[0], rows[2]}


def test_run_of_empty_documents(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
