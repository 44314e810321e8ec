"""Sharing of readings from the command line: make a bundle of a library, look into one, take one in.

    python -m ledgerline.share export LIBRARY BUNDLE --contributor NAME
    python -m ledgerline.share read BUNDLE
    python -m ledgerline.share import BUNDLE PAGES LIBRARY

A library is a folder of extraction files or a Parquet table of records; pages are a
Parquet table (identifier, page, text).  Fetching and sending bundles is left to other tools.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.keys import record_key
from ledgerline.operators import evidence, ledger, records
from ledgerline.sources import readers, writers

#: Columns of a record as a bundle holds it.
FIELDS = ("kind", "parameter", "value", "unit", "qualifier", "stream", "place", "period", "facility", "condition", "confidence", "identifier", "page", "quote")


def flat(extracted: DataFrame) -> DataFrame:
    """Records with their citation as columns and their content key."""
    cited = {"identifier": "provenance.identifier", "page": "provenance.page", "quote": "provenance.source_text"}
    x = extracted.select(*(F.col(cited.get(c, c)).alias(c) for c in FIELDS))
    return x.withColumn("key", record_key())


def export(library: DataFrame, path: str, contributor: str = "anonymous", note: str = "") -> DataFrame:
    """Write the records of a library (FIELDS, key), each key once, as one bundle folder; (bundle_id, n_records, identifiers)."""
    x = ledger.first_wins(library.select(*FIELDS, "key").withColumn("ord", F.lit(0)), "key", "ord").drop("ord")
    head = writers.bundle(x).withColumn("contributor", F.lit(contributor)).withColumn("note", F.lit(note))
    x.write.mode("errorifexists").parquet(f"{path}/records")
    head.write.mode("errorifexists").json(f"{path}/bundle")
    return head


def take_in(bundle: DataFrame, pages: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Verify the records of a bundle against pages and merge what they support into a library table: (counts by state, the fresh records).

    A bundle that is too large is refused as a whole, and so is one without a verified
    record or with a failed one.
    """
    told = records.bundle_gate(bundle.withColumn("_all", F.lit(1)), ["_all"]).first()
    if told and told["error"]:
        raise ValueError(told["error"])
    x = bundle.withColumn("condition", evidence.grounded_condition("condition", "quote"))
    judged = evidence.verdicts(x, pages, ["identifier", "page"]).cache()
    counts = ledger.verdict_counts(judged.withColumn("_all", F.lit(1)), ["_all"]).drop("_all")
    verdict = counts.first()
    supported = judged.where("state in ('verified', 'unchecked')").withColumn("quote", F.coalesce("matched", "quote")).drop("state", "why", "matched")
    keyed = supported.select(*FIELDS).withColumn("key", record_key()).withColumn("ord", F.lit(0))
    accepted = bool(verdict and verdict["accepted"])
    return counts, writers.merge(keyed, path) if accepted else keyed.limit(0)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ledgerline.share")
    commands = parser.add_subparsers(dest="command", required=True)
    out = commands.add_parser("export")
    out.add_argument("library"), out.add_argument("bundle"), out.add_argument("--contributor", default="anonymous"), out.add_argument("--note", default="")
    commands.add_parser("read").add_argument("bundle")
    into = commands.add_parser("import")
    into.add_argument("bundle"), into.add_argument("pages"), into.add_argument("library")
    given = parser.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if given.command == "export":
        head = export(flat(readers.extraction_records(spark, f"{given.library}/*.json")), given.bundle, given.contributor, given.note)
        print(head.first().asDict())
    elif given.command == "read":
        print(spark.read.json(f"{given.bundle}/bundle").first().asDict())
        spark.read.parquet(f"{given.bundle}/records").groupBy("place", "parameter").agg(F.count("*").alias("n")).orderBy(F.desc("n")).show(20, truncate=False)
    else:
        counts, fresh = take_in(spark.read.parquet(f"{given.bundle}/records"), spark.read.parquet(given.pages), given.library)
        print(counts.first().asDict(), fresh.count())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
