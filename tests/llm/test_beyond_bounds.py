"""The ways taken where a side is too large to broadcast give the same rows."""

from test_exact import DOCS, brute_bytes, brute_words, corpus, groups, hot

from ledgerline.llm import common, op1_suffix, op3_recompression, op7_minhash, op10_decontam, windows


def test_texts_fetched_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(windows, "FETCH_IDS", 0)
    rows = corpus(7)
    df = spark.createDataFrame(rows, DOCS)
    assert sorted((tuple(r) for r in op1_suffix.dedup(df, 60, 20, text_out=False).collect()), key=str) == brute_bytes(rows, 60)
    assert sorted((tuple(r) for r in op3_recompression.dedup(df, 13, text_out=False).collect()), key=str) == brute_words(rows, 13)


def test_near_duplicates_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(op7_minhash, "FETCH_IDS", 0)
    rows = hot(9, 60, (0, 2, 9, 12, 30))
    got = op7_minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 2, 80).collect()
    assert sorted((tuple(r) for r in got), key=str) == groups(rows, 2, 80)


def test_benchmark_by_shuffle(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 90}" for k in range(60))) for i in range(20)]
    items = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20))), (2, "nothing of the kind"), (3, "w5 w6"), (4, "w30")], "item_id long, text string")
    df = spark.createDataFrame(rows, DOCS)
    want = sorted(tuple(r) for r in op10_decontam.overlaps(df, items).collect())
    monkeypatch.setattr(op10_decontam, "BROADCAST_WORDS", 0)
    assert sorted(tuple(r) for r in op10_decontam.overlaps(df, items).collect()) == want and want


def test_joins_by_shuffle(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], DOCS)
    ids = spark.createDataFrame([(2,), (None,)], "doc_id long")
    for bound in (0, 10):
        assert [r.doc_id for r in common.without(df, ids, broadcast_rows=bound).collect()] == [1]
        assert [r.text for r in common.joined_labels(df, ids, broadcast_rows=bound).collect()] == ["b"]
