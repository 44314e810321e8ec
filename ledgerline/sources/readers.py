"""Sources: extraction files, catalogue, gazetteer, stations, answer keys, scanned pages, demand logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROVENANCE = T.StructType().add("identifier", "string").add("page", "integer").add("source_text", "string").add("extractor", "string").add("path", "string").add("page_url", "string")
RECORD = T.StructType()
for _name in ("kind", "parameter"):
    RECORD.add(_name, "string")
RECORD.add("value", "double")
for _name in ("unit", "qualifier", "stream", "place", "period", "facility", "condition"):
    RECORD.add(_name, "string")
RECORD.add("confidence", "double").add("comparability_note", "string").add("notes", "string").add("provenance", PROVENANCE).add("raw", T.MapType(T.StringType(), T.StringType()))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("json"))


def extraction_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of extraction files, told by their shape: a JSON object with a ``place`` key, even an empty one.

    file, file_place, ord (file order, then place in the file), and the record's columns.
    """
    has_place = F.array_contains(F.json_object_keys("json"), "place")
    x = _files(spark, path).where(F.coalesce(has_place, F.lit(False)))
    x = x.withColumn("d", F.from_json("json", T.StructType().add("place", "string").add("records", T.ArrayType(RECORD))))
    x = x.select("file", F.col("d.place").alias("file_place"), F.posexplode("d.records").alias("at", "r"))
    return x.select("file", "file_place", F.struct("file", "at").alias("ord"), "r.*")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue items; fields that are a text or a list of texts become lists, the year its first four characters."""
    x = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.col("value").alias("j"))
    one = lambda c: F.get_json_object("j", f"$.{c}")
    many = lambda c: F.when(one(c).startswith("["), F.from_json(one(c), "array<string>")).when(one(c).isNotNull(), F.array(one(c)))
    return x.select("ord", one("identifier").alias("identifier"), one("title").alias("title"), F.substring(one("year"), 1, 4).try_cast("int").alias("year"), one("date").alias("date"), *(many(c).alias(c) for c in ("language", "subject", "collection", "publisher")), *(one(c).try_cast("long").alias(c) for c in ("imagecount", "downloads", "item_size")))


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    schema = "id string, name string, generic_term string, generic_category string, concise_code string, lat double, lon double, location string, decision_date string"
    return spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE")


def stations(spark: SparkSession, path: str) -> DataFrame:
    """Features with two coordinates at least; a drainage area that is no number is null."""
    props = "properties struct<STATION_NUMBER:string,IDENTIFIER:string,STATION_NAME:string,STATUS_EN:string,DRAINAGE_AREA_GROSS:string>"
    x = _files(spark, path).select(F.from_json("json", f"struct<features:array<struct<{props.replace(' ', ':', 1)},geometry:struct<coordinates:array<double>>>>>").alias("d"))
    x = x.select(F.explode("d.features").alias("f")).where(F.size("f.geometry.coordinates") >= 2)
    p = "f.properties."
    return x.select(F.coalesce(p + "STATION_NUMBER", p + "IDENTIFIER").alias("gauge"), F.col(p + "STATION_NAME").alias("name"), F.col(p + "STATUS_EN").alias("status"), F.col(p + "DRAINAGE_AREA_GROSS").try_cast("double").alias("area"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"), F.get("f.geometry.coordinates", F.lit(0)).alias("lon"))


def answer_key(spark: SparkSession, path: str) -> DataFrame:
    """identifier, page, ord and the values of a gold key, one row a value."""
    value = "struct<kind:string,parameter:string,value:double,unit:string,qualifier:string,stream:string,period:string,place:string,facility:string,approximate:boolean>"
    x = _files(spark, path).select(F.from_json("json", f"struct<identifier:string,pages:map<string,array<{value}>>>").alias("d"))
    x = x.select("d.identifier", F.explode("d.pages").alias("page", "values")).select("identifier", F.col("page").try_cast("int").alias("page"), F.posexplode("values").alias("ord", "v"))
    return x.select("identifier", "page", "ord", "v.*")


def demand(spark: SparkSession, path: str) -> DataFrame:
    """(place, visitors) of a log with one JSON object (place, who) a line."""
    x = spark.read.json(path, schema="place string, who string")
    return x.where("place is not null").groupBy(F.lower(F.trim("place")).alias("place")).agg(F.count_distinct("who").alias("visitors"))


def scanned_pages(pages: DataFrame, key: str = "identifier", xml: str = "xml") -> DataFrame:
    """(key, page, width, height, ocr_confidence, text) of scanned-text XML with OBJECT, PARAGRAPH, LINE and WORD elements.

    Read with regular expressions, as such files are often not well-formed.  Lines
    and paragraphs keep their breaks; confidence is the mean of the words' in 0..1.
    Pages without words are left out.
    """
    x = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)(<OBJECT\b.*?</OBJECT>)"), F.lit(1))).alias("at", "o"))
    size = lambda n: F.regexp_extract("o", rf'<OBJECT\b[^>]*\b{n}="(\d+)"', 1).try_cast("int")
    every = lambda c, tag: F.regexp_extract_all(c, F.lit(rf"(?s)(<{tag}\b.*?</{tag}>)"), F.lit(1))
    line = lambda c: F.array_join(F.transform(every(c, "WORD"), lambda w: F.regexp_replace(w, r"(?s)<[^>]*>", "")), " ")
    text = F.array_join(F.transform(every(F.col("o"), "PARAGRAPH"), lambda p: F.array_join(F.transform(every(p, "LINE"), line), "\n")), "\n\n")
    sure = F.transform(F.regexp_extract_all("o", F.lit(r'x-confidence="(\d+(?:\.\d+)?)"'), F.lit(1)), lambda v: v.cast("double"))
    mean = F.aggregate(sure, F.lit(0.0), lambda a, v: a + v) / F.size(sure) / 100.0
    x = x.select(key, (F.col("at") + 1).alias("page"), size("width").alias("width"), size("height").alias("height"), F.when(F.size(sure) > 0, F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean)), 4)).alias("ocr_confidence"), text.alias("text"))
    return x.where(F.trim("text") != "")


def html_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, title, text, n_links) of web pages: scripts, styles and tags removed, blanks folded."""
    body = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", " "), r"\s+", " "))
    return pages.select(key, F.trim(F.regexp_extract(F.coalesce(F.col(html), F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), text.alias("text"), F.regexp_count(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?i)<a\s")).alias("n_links"))


def scoped_corpus(spark: SparkSession, path: str, history: DataFrame, aliases: DataFrame, gazetteer_rows: DataFrame, non_places: list[str] = ()) -> DataFrame:
    """extraction_records() with places as their files scope them and parts of plants told their plant: the form in which records get their keys."""
    from ledgerline.operators.places import attach_subunits, scope_records

    x = extraction_records(spark, path).withColumn("identifier", F.col("provenance.identifier"))
    return scope_records(attach_subunits(x), history, aliases, gazetteer_rows, non_places)


def contributions(spark: SparkSession, path: str) -> DataFrame:
    """Records that people submitted, one row each: the submission's claim_id, source, contributor, note and disputes, then extraction columns."""
    head = T.StructType().add("claim_id", "string").add("place", "string").add("source", "string").add("contributor", "string").add("note", "string").add("disputes", "string").add("records", T.ArrayType(RECORD))
    x = _files(spark, path).withColumn("d", F.from_json("json", head))
    told = {"source": "person", "contributor": "anonymous", "note": "", "disputes": ""}
    x = x.select("file", F.col("d.place").alias("file_place"), F.col("d.claim_id").alias("submitted_id"), *(F.coalesce(F.nullif(F.col(f"d.{c}"), F.lit("")), F.lit(v)).alias(c) for c, v in told.items()), F.posexplode("d.records").alias("at", "r"))
    return x.select("file", "file_place", "submitted_id", *told, F.struct("file", "at").alias("ord"), "r.*")


def vision_trial(spark: SparkSession, path: str) -> DataFrame:
    """Records of a trial file, an object keyed by page; pages with an error are left out."""
    row = T.StructType().add("error", "string").add("records", T.ArrayType(RECORD))
    x = _files(spark, path).select("file", F.explode(F.from_json("json", T.MapType(T.StringType(), row))).alias("page_key", "d"))
    x = x.where("d is not null and d.error is null").select("file", "page_key", F.posexplode("d.records").alias("at", "r"))
    return x.select("file", F.lit(None).cast("string").alias("file_place"), F.struct("file", F.col("page_key"), "at").alias("ord"), "r.*")


def public_claims(extracted: DataFrame, vision: DataFrame, contributed: DataFrame) -> DataFrame:
    """All claims by content, each once: what extraction found first, then the vision trial's, then what people submitted."""
    from ledgerline.functions.keys import claim_key, record_key, slot_key

    fields = [f.name for f in RECORD.fields]

    def claims(x: DataFrame, order: int, source: str, contributor: str) -> DataFrame:
        given = {"source": source, "contributor": contributor, "note": "", "disputes": ""}
        x = x.select(*(F.col(c) if c in x.columns else F.lit(v).alias(c) for c, v in given.items()), F.lit(order).alias("_from"), F.to_json("ord").alias("_at"), *fields, F.col("provenance.identifier").alias("identifier"), F.col("provenance.page").alias("page"), F.col("provenance.source_text").alias("quote"))
        x = x.withColumn("slot", slot_key()).withColumn("key", record_key())
        return x.withColumn("claim_id", claim_key("identifier", "page", "quote", "key", "slot")).withColumn("raw", F.to_json("raw"))

    every = claims(extracted, 0, "extraction", "anonymous").unionByName(claims(vision, 1, "extraction", "vision")).unionByName(claims(contributed, 2, "person", "anonymous"))
    rest = [c for c in every.columns if c not in ("claim_id", "_from", "_at")]
    return every.groupBy("claim_id").agg(F.min_by(F.struct(*rest), F.struct("_from", "_at")).alias("m")).select("claim_id", "m.*")


TERM = "canonical string, substance string, measure string, domain string, aliases array<string>, typical_units array<string>, readings_covered long, reviewed boolean"


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a vocabulary file (a list, or an object with ``terms``), lower case; a missing file is an empty vocabulary."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], TERM)
    one = T.ArrayType(T.StructType.fromDDL(TERM))
    listed_in = F.from_json("json", T.StructType().add("terms", one))["terms"]
    x = _files(spark, path).select(F.explode(F.when(F.ltrim("json").startswith("["), F.from_json("json", one)).otherwise(listed_in)).alias("t")).select("t.*")
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    listed = lambda c, f: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), f), lambda v: v != "")
    x = x.select(*(low(c).alias(c) for c in ("canonical", "substance", "measure", "domain")), listed("aliases", lambda v: F.lower(F.trim(v))).alias("aliases"), listed("typical_units", F.trim).alias("typical_units"), F.coalesce("readings_covered", F.lit(0)).alias("readings_covered"), F.coalesce("reviewed", F.lit(False)).alias("reviewed"))
    return x.where("canonical <> ''")


def payload_kind(json) -> Column:
    """What a result file holds by its shape: ``extraction`` (records of a place), ``coverage`` (municipalities or terms), or ``other``."""
    keys = F.json_object_keys(F.col(json) if isinstance(json, str) else json)
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    return F.when(has("records") & has("place"), "extraction").when(has("terms") & (has("archive_language") | has("stopping_rule")), "coverage").otherwise("other")


def bc_holdings(items: DataFrame) -> DataFrame:
    """(series, n, first_year, last_year) of the catalogue's items about British Columbia: the part of a title before its first colon, comma, bracket or year."""
    about = F.col("title").rlike(r"(?i)british columbia|\bB\.?\s?C\.?\b")
    name = F.trim(F.regexp_extract("title", r"^([^:,(\[\d]+)", 1))
    x = items.where(about).withColumn("series", F.when(name == "", F.col("title")).otherwise(name))
    return x.groupBy("series").agg(F.count_distinct("identifier").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
