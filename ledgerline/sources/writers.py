"""Sinks: bundles, merges, published places, exports."""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.keys import bundle_key, slug, visitor_tag
from ledgerline.operators.evidence import grounded_condition, verdicts
from ledgerline.operators.ledger import fresh
from ledgerline.operators.places import place_key
from ledgerline.operators.repairs import recovery_summary
from ledgerline.operators.vocabulary import validation_errors


def bundle(records: DataFrame, key: str = "key") -> DataFrame:
    """(bundle_id, n_records, identifiers): content address of a set of records."""
    return records.agg(bundle_key(F.col(key)).alias("bundle_id"), F.count("*").alias("n_records"), F.sort_array(F.collect_set("identifier")).alias("identifiers"))


def _path(spark, path: str):
    """(file system, path) of a location, whatever store it is in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


@contextmanager
def transaction(spark, path: str, wait: float = 60.0, every: float = 0.1):
    """The only writer of ``path`` while the block runs: a lock file beside it, created only if it is not there.

    Raises TimeoutError where another writer holds the lock for longer than ``wait`` seconds.
    """
    fs, lock = _path(spark, path.rstrip("/") + ".lock")
    until = time.monotonic() + wait
    while not fs.createNewFile(lock):
        if time.monotonic() > until:
            raise TimeoutError(f"{lock} is held by another writer")
        time.sleep(every)
    try:
        yield
    finally:
        fs.delete(lock, False)


def create_new(spark, path: str, content: bytes) -> bool:
    """Write a small file as a whole unless it is there: it gets its name only when it is complete.  Whether it was written."""
    fs, target = _path(spark, path)
    if fs.exists(target):
        return False
    _, staged = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(staged, False)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()
    with transaction(spark, path):
        if fs.exists(target) or not fs.rename(staged, target):
            fs.delete(staged, False)
            return False
    return True


def free_path(spark, folder: str, stem: str, suffix: str = ".json") -> str:
    """A path in a folder that no file has: the stem, else the stem with a number behind it."""
    n = 1
    while True:
        path = f"{folder.rstrip('/')}/{stem}{'' if n == 1 else f'-{n}'}{suffix}"
        fs, p = _path(spark, path)
        if not fs.exists(p):
            return path
        n += 1


def merge(incoming: DataFrame, path: str, key: str = "key", ord_: str = "ord") -> DataFrame:
    """Append to the Parquet table at ``path`` what it does not hold yet; nothing fresh, nothing written.  Returns the fresh rows.

    Looking and writing are one transaction, so two writers never add one key twice.
    The new files are written aside and moved in when they are complete.
    """
    spark = incoming.sparkSession
    with transaction(spark, path):
        fs, target = _path(spark, path)
        there = fs.exists(target) and any(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(target))
        existing = spark.read.parquet(path) if there else incoming.limit(0)
        fresh_rows = fresh(incoming, existing, key, ord_)
        aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}.staged"
        fresh_rows.write.parquet(aside)
        new = spark.read.parquet(aside)
        _, staged = _path(spark, aside)
        if new.isEmpty():
            fs.delete(staged, True)
            return incoming.limit(0).select(*new.columns)
        fs.mkdirs(target)
        moved = []
        for status in fs.listStatus(staged):
            name = status.getPath().getName()
            if name.endswith(".parquet"):
                goal = f"{path.rstrip('/')}/{name}"
                if not fs.rename(status.getPath(), _path(spark, goal)[1]):
                    raise OSError(f"cannot move {name} to {path}")
                moved.append(goal)
        fs.delete(staged, True)
    return spark.read.schema(new.schema).parquet(*moved)


def submit(records: DataFrame, pages: DataFrame, folder: str, contributor: str = "anonymous", note: str = "", disputes: str = "") -> list[tuple[str, str, bool]]:
    """Offer a few readings (identifier, page, quote, value, condition, ...): (claim id, why, stored) of each.

    A condition whose words are not in the sentence is dropped first.  Only what the page
    supports is stored, one file a claim, named by its content, so offering it again
    stores nothing.
    """
    spark = records.sparkSession
    x = records.withColumn("condition", grounded_condition("condition", "quote"))
    x = x.withColumn("claim_id", F.substring(F.sha2(F.to_json(F.struct(*sorted(x.columns))), 256), 1, 24))
    judged = verdicts(x, pages, ["identifier", "page"])
    head = {"claim_id": F.col("claim_id"), "contributor": F.lit(contributor), "source": F.lit("correction" if disputes else "person"), "note": F.lit(note), "disputes": F.lit(disputes), "verified_because": F.col("why")}
    document = F.to_json(F.struct(*(c.alias(n) for n, c in head.items()), F.array(F.struct(*records.columns)).alias("records")))
    out = []
    for r in judged.select("claim_id", "state", "why", document.alias("document")).orderBy("claim_id").toLocalIterator():
        good = r["state"] in ("verified", "unchecked")
        out.append((r["claim_id"], r["why"], good and create_new(spark, f"{folder.rstrip('/')}/{r['claim_id']}.json", r["document"].encode())))
    return out


def save_vocabulary(terms: DataFrame, path: str, note: str = "") -> None:
    """One JSON file of the terms, the most used first; a vocabulary with errors is refused."""
    wrong = [f"{r['canonical']}: {r['problem']}" for r in validation_errors(terms).limit(20).collect()]
    if wrong:
        raise ValueError("invalid vocabulary: " + "; ".join(wrong))
    spark = terms.sparkSession
    fields = [c for c in terms.columns if c not in ("readings_covered", "canonical")]
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("readings_covered")).alias("k"), "canonical", *fields)))
    listed = F.transform(ordered, lambda t: F.struct(t["canonical"].alias("canonical"), *(t[c].alias(c) for c in fields), (-t["k"]).alias("readings_covered")))
    text = terms.agg(F.to_json(F.struct(F.lit(1).alias("version"), F.lit(note).alias("note"), F.count("*").alias("n_terms"), listed.alias("terms"))).alias("j")).first()["j"]
    fs, target = _path(spark, path)
    with transaction(spark, path):
        stream = fs.create(target, True)
        stream.write(bytearray(text.encode()))
        stream.close()


def library_json(records: DataFrame, path: str) -> None:
    """The whole library as JSON lines, one record a line, in files that Spark writes side by side."""
    records.write.mode("errorifexists").json(path)


def publish(records: DataFrame, path: str, place: str = "place") -> None:
    """Supported records by place; a place's folder is replaced as a whole, others stay."""
    records.where("state = 'verified'").withColumn("place_slug", slug(place)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("place_slug").json(path)


def geojson(places: DataFrame) -> DataFrame:
    """One JSON text a row: Feature of (place, lat, lon, n)."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return places.where("lat is not null and lon is not null").select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct("place", "n").alias("properties"))).alias("value"))


def unlocated(records: DataFrame, gazetteer: DataFrame, least: int = 2) -> DataFrame:
    """Places of ``least`` records or more that the gazetteer does not have."""
    n = records.groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.join(gazetteer.select(F.lower("name").alias("g")).distinct(), F.lower("place") == F.col("g"), "left_anti")


def record_asks(asks: DataFrame, path: str, salt: str) -> DataFrame:
    """Add what visitors asked for (place, peer) to a demand table: each visitor once a town, told by a tag that cannot be turned back.  The new rows."""
    x = asks.where(F.trim("place") != "").select(place_key("place").alias("place"), visitor_tag(salt, "peer").alias("tag"))
    return merge(x.withColumn("key", F.concat_ws("|", "place", "tag")).withColumn("ord", F.lit(0)), path)


def recovery_report(guesses: DataFrame, path: str) -> DataFrame:
    """Add year guesses (identifier, basis, confidence, year, truth) to a run's table and sum up all that it holds: a run that was cut off goes on where it was."""
    merge(guesses.withColumn("key", F.col("identifier")).withColumn("ord", F.lit(0)), path)
    return recovery_summary(guesses.sparkSession.read.parquet(path))
