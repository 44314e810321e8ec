"""Corpus preparation: quality, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and reread as the next stage's docs.  All but the last return the columns of docs.
Columns beyond those a stage works on pass through it, whatever their names.

Defined cases, for every stage: an empty table gives an empty one; a null text counts as
empty; rows without an id, and rows that share one, are judged each by its own text; a
repeated row is judged like the first.  Of rows equal in id and text near-dedup keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import common, op2_quality, op4_pii, op6_packing, op7_minhash, op10_decontam


def _numbered(docs: DataFrame) -> tuple[DataFrame, list[str], str]:
    """docs with columns c0, c1, ...; their names before; the name that text has now."""
    names = docs.columns
    return docs.toDF(*(f"c{i}" for i in range(len(names)))), names, f"c{names.index('text')}"


def _named(docs: DataFrame, names: list[str]) -> DataFrame:
    return docs.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))


def _sent(rows: DataFrame, broadcast_rows: int = 2_000_000) -> DataFrame:
    """A side of a join, broadcast up to a counted size."""
    return F.broadcast(rows) if rows.count() <= broadcast_rows else rows


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Learned from labelled documents outside the held-out fifth.  Null and empty texts get
    the score of a text without words; without labels every score is one half, and all stay.
    """
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "quality").where(~common.held_out("doc_id", 5, 0))
    vectors, net = op2_quality.train(docs.select("doc_id", "text"), labels)
    rows, names, text = _numbered(docs)
    return _named(op2_quality.score(rows, vectors, net, text=text, keep=tuple(rows.columns)).where(F.col("score") >= op2_quality.THRESHOLD), names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest id: five-word shingles, similarity 0.8.

    Each row is judged by its own text, whatever rows share its id or have none; repeated rows are one document.
    """
    rows, names, text = _numbered(docs)
    key = common.row_key(f"c{names.index('doc_id')}", text)
    found = op7_minhash.near_duplicates(docs.select(common.row_key().alias("doc_id"), "text"), width=5, percent=80)
    group = found.where("not kept").select(F.col("doc_id").alias("key"), "component_id")
    group = common.checkpointed(group.unionByName(group.select(F.col("component_id").alias("key"), "component_id")).distinct())
    first = docs.select(common.row_key().alias("key"), "doc_id").join(_sent(group), "key")
    first = first.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    first = common.checkpointed(first.select("component_id", F.col("first.key").alias("first")))
    gone = common.checkpointed(group.join(_sent(first), "component_id").where("key <> first").select("key"))
    kept = _named(common.without(rows.withColumn("key", key), gone, key="key"), names)
    twice = kept.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    rows, names, text = _numbered(kept)
    return _named(rows.dropDuplicates([f"c{names.index('doc_id')}", text]), names)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Null and empty texts hold none; benchmark rows count whether they have an id or not; an
    empty benchmark leaves all documents.
    """
    return op10_decontam.clean(docs, common.table(spark, sf_dir, "benchmark").select("item_id", "text"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data replaced by their kind; n_chars follows the text.

    A null text stays null, and its n_chars is null then.
    """
    field = op4_pii.train(docs.select("doc_id", "text"))
    rows, names, text = _numbered(docs)
    found = op4_pii.find(rows, field, text=text, keep=tuple(rows.columns)).withColumn(text, F.col("redacted"))
    if "n_chars" in names:
        size = f"c{names.index('n_chars')}"
        found = found.withColumn(size, F.length(text).cast(rows.schema[size].dataType))
    return _named(found, names)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(shard, bin, doc_id, start, n_words): where each piece of each document goes.

    Documents without words are in no bin; documents without a source conflict with none.
    """
    return op6_packing.pack(docs.select("doc_id", "text", "source"))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("best-fit packing", packing),
]

#: Trained models decide which rows stay, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is stored in the shared checkpoint folder."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
