"""Planning of reading runs: which reports, in what order, what is left, what they cost and how they went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.places import place_key

# Titles that are read, device names that are no file names, bounds of confidence bands.
ANNUAL = r"(?i)annual report|sewage treatment plant"
DEVICES = (*("con", "prn", "aux", "nul", "clock$"), *(f"{d}{i}" for d in ("com", "lpt") for i in range(1, 10)))
BANDS = ((0.9, "0.90-1.00"), (0.8, "0.80-0.89"), (0.7, "0.70-0.79"), (0.5, "0.50-0.69"), (0.0, "0.00-0.49"))


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _cut(n: int):
    return lambda i: F.substr(F.col("_t"), i, F.lit(n))


def report_selection(items: DataFrame, towns: DataFrame) -> DataFrame:
    """(place, identifier, at): the reports of each town (place) among items (identifier, title, year, ord), by year as text, those without a year last."""
    t = towns.select("place", F.lower("place").alias("_p")).where("_p <> ''").distinct().withColumn("_g", F.substring("_p", 1, 3))
    x = items.where(F.col("title").rlike(ANNUAL)).withColumn("_t", F.lower("title"))
    # a town and the titles that hold it share the first letters of the town
    parts = F.flatten(F.array(*(F.transform(F.sequence(F.lit(1), F.length("_t")), _cut(n)) for n in (1, 2, 3))))
    x = x.withColumn("_g", F.explode(F.array_distinct(parts))).join(t, "_g").where(F.contains("_t", "_p"))
    order = Window.partitionBy("place").orderBy(F.coalesce(F.nullif(F.col("year").cast("string"), F.lit("")), F.lit("9999")), "ord")
    return x.withColumn("at", F.row_number().over(order)).select("place", "identifier", "at")


def selection_fingerprint(selection: DataFrame) -> DataFrame:
    """(place, n, fingerprint): digest of each town's identifiers in order; another order is another selection."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("at", "identifier"))), lambda x: x["identifier"])
    x = selection.groupBy("place").agg(ids.alias("ids"))
    return x.select("place", F.size("ids").alias("n"), F.sha2(F.to_json("ids"), 256).alias("fingerprint"))


def file_slug(place) -> Column:
    """File name of a place: lower case with hyphens where that is safe, else readable letters and a digest of the whole name."""
    name = F.trim(F.regexp_replace(_col(place), r"\s+", " "))
    plain = F.replace(F.lower(name), F.lit(" "), F.lit("-"))
    safe = plain.rlike(r"^[a-z0-9][a-z0-9._-]{0,99}$") & ~plain.endswith(".") & ~F.split_part(plain, F.lit("."), F.lit(1)).isin(*DEVICES)
    words = F.rtrim(F.substring(F.replace(place_key(name), F.lit(" "), F.lit("-")), 1, 60), F.lit("-"))
    digest = F.substring(F.sha2(F.lower(name).cast("binary"), 256), 1, 16)
    return F.when(name == "", None).when(safe, plain).otherwise(F.concat(F.coalesce(F.nullif(words, F.lit("")), F.lit("place")), F.lit("--"), digest))


def slug_collisions(places: DataFrame) -> DataFrame:
    """(slug, places): names that would share a file."""
    return places.select(file_slug("place").alias("slug"), "place").groupBy("slug").agg(F.sort_array(F.collect_set("place")).alias("places")).where("size(places) > 1")


def plan(selection: DataFrame, results: DataFrame, towns: int, skip_done: bool = True) -> DataFrame:
    """The next towns (place, n, state, modified): those begun before, the newest first, then new ones with most reports.

    results: (place, valid, receipt, pass_seen, modified).  What is complete is left out
    if asked; what is there but not well formed is told as blocked-invalid.
    """
    n = selection.groupBy("place").agg(F.count("*").alias("n"))
    x = n.join(results, "place", "left")
    there = F.col("modified").isNotNull()
    done = F.coalesce("receipt", F.lit(False)) | F.coalesce("pass_seen", F.lit(False))
    state = F.when(~there, "new").when(F.coalesce("receipt", F.lit(False)), "receipt-backed").when(F.coalesce("pass_seen", F.lit(False)), "legacy-pass-observed").when(~F.coalesce("valid", F.lit(False)), "blocked-invalid").otherwise("resume-unverified")
    x = x.withColumn("state", state).where(~done if skip_done else F.lit(True))
    return x.select("place", "n", "state", "modified").orderBy((F.col("state") == "new").cast("int"), F.desc("modified"), F.desc("n"), "place").limit(towns)


def snapshots(results: DataFrame) -> DataFrame:
    """results (place, file_place, n_records, records, attempted) with ``valid`` and ``why``: whether a file is whole and about its place."""
    fold = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    why = (
        F.when(~F.coalesce(fold("place") == fold("file_place"), F.lit(False)), "another place")
        .when(F.col("records").isNull() | F.col("attempted").isNull(), "no lists")
        .when(~F.coalesce(F.col("n_records") == F.size("records"), F.lit(False)), "count differs")
        .when(F.exists("attempted", lambda a: a.isNull() | (a == "")), "blank page key")
    )
    return results.withColumn("why", why).withColumn("valid", F.col("why").isNull())


def complete(attempted: DataFrame, expected: DataFrame) -> DataFrame:
    """(place, complete, missing, unexpected): whether the identifiers attempted (place, identifier) are those expected."""
    a, e = attempted.distinct().withColumn("a", F.lit(1)), expected.select("place", "identifier").distinct().withColumn("e", F.lit(1))
    x = e.join(a, ["place", "identifier"], "full").groupBy("place").agg(F.sort_array(F.collect_set(F.when(F.col("a").isNull(), F.col("identifier")))).alias("missing"), F.sort_array(F.collect_set(F.when(F.col("e").isNull(), F.col("identifier")))).alias("unexpected"))
    return x.withColumn("complete", (F.size("missing") == 0) & (F.size("unexpected") == 0))


def title_family(title) -> Column:
    """Serial key of a title: letters only, numbers dropped."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(_col(title), F.lit(""))), r"\d+", " "), "[^a-z]+", " "))


def vocabulary_family(title) -> Column:
    """Family of a title for counting documents of one wording: its first six words that are no numbers."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(_col(title), F.lit(""))), r"[^\p{L}\p{N}\s]", " ")), r"\s+")
    return F.array_join(F.slice(F.filter(words, lambda w: (w != "") & ~w.rlike(r"^\d+$")), 1, 6), " ")


def disjoint_pools(items: DataFrame, unknown: int, validation: int, seed: int) -> DataFrame:
    """items (identifier, title, year) with ``pool``: unknown (without a year) and validation (with one), drawn by a hash; a family is in one pool only."""
    x = items.withColumn("family", title_family("title")).withColumn("_h", F.xxhash64(F.lit(seed), "identifier"))
    blank = F.col("year").isNull()
    first = x.where(blank).orderBy("_h", "identifier").limit(unknown)
    rest = x.where(~blank).join(first.select("family").distinct(), "family", "left_anti")
    one = Window.partitionBy("family").orderBy("_h", "identifier")
    rest = rest.withColumn("_k", F.row_number().over(one)).where("_k = 1").orderBy("_h", "identifier").limit(validation).drop("_k")
    return first.withColumn("pool", F.lit("unknown")).unionByName(rest.withColumn("pool", F.lit("validation"))).drop("_h")


def trial_pages(pages: DataFrame, strata: int = 30, documents: int = 3, seed: int = 7) -> DataFrame:
    """One page of at most so many documents of each of the largest strata: pages (stratum, identifier, page)."""
    size = pages.groupBy("stratum").agg(F.count_distinct("identifier").alias("n")).orderBy(F.desc("n"), "stratum").limit(strata)
    h = F.xxhash64(F.lit(seed), "identifier", "page")
    one = pages.join(size.select("stratum"), "stratum").groupBy("stratum", "identifier").agg(F.min(F.struct(h.alias("h"), "page")).alias("m"))
    order = Window.partitionBy("stratum").orderBy(F.xxhash64(F.lit(seed), "identifier"), "identifier")
    return one.withColumn("k", F.row_number().over(order)).where(F.col("k") <= documents).select("stratum", "identifier", F.col("m.page").alias("page"))


def upper_middle(values) -> Column:
    """The middle element of sorted values, the upper one of two: what trial summaries call their median."""
    v = F.array_sort(_col(values))
    return F.get(v, F.floor(F.size(v) / 2).cast("int"))


def trial_summary(rows: DataFrame) -> DataFrame:
    """One row of trial rows (seconds, n_records, n_in_ocr, error): pages, errors, records, share in the scan's text, middle seconds and records."""
    good = F.col("error").isNull()
    return rows.agg(
        F.count("*").alias("pages"), F.count_if(~good).alias("errors"), F.coalesce(F.sum(F.when(good, F.col("n_records"))), F.lit(0)).alias("records"),
        (F.sum(F.when(good, F.col("n_in_ocr"))) / F.nullif(F.sum(F.when(good, F.col("n_records"))), F.lit(0))).alias("share_in_ocr"),
        upper_middle(F.collect_list(F.when(good, F.col("seconds")))).alias("middle_seconds"), upper_middle(F.collect_list(F.when(good, F.col("n_records")))).alias("middle_records"),
    )


def confidence_band(confidence) -> Column:
    c = _col(confidence)
    out = F.lit(None).cast("string")
    for low, name in reversed(BANDS):
        out = F.when(c >= low, name).otherwise(out)
    return out


def guess_is_valid(evidence, text) -> Column:
    """Whether a date's evidence stands word for word in the text it is said to be from."""
    e, t = _col(evidence), _col(text)
    return (F.coalesce(e, F.lit("")) != "") & F.coalesce(F.contains(t, e), F.lit(False))


def cost_model(prices: DataFrame, pages: int, worth: float, text_share: float, tokens: dict[str, float], throughput_penalty: float) -> DataFrame:
    """What reading a collection takes: prices (option, usd_per_hour, low, high tokens a second) with hours, days and cost, of all and of the text alone.

    tokens: text_in, text_out, vision_in, vision_out a page.
    """
    read = int(pages * worth)
    text = int(read * text_share)
    words, images = text * (tokens["text_in"] + tokens["text_out"]), (read - text) * (tokens["vision_in"] + tokens["vision_out"])

    def hours(speed: str) -> tuple[Column, Column]:
        own = F.lit(float(words)) / F.col(speed) / 3600
        return own, own + F.lit(float(images)) / (F.col(speed) * throughput_penalty) / 3600

    (text_low, low), (text_high, high) = hours("high"), hours("low")
    cost = lambda h: F.round(h * F.col("usd_per_hour")).cast("long")
    return prices.select("option", "usd_per_hour", F.round(low / 24, 1).alias("days_low"), F.round(high / 24, 1).alias("days_high"), cost(low).alias("usd_low"), cost(high).alias("usd_high"), cost(text_low).alias("usd_text_low"), cost(text_high).alias("usd_text_high"))


def rejected_again(rejects: DataFrame, pages: DataFrame, problems: Column, can_referee) -> DataFrame:
    """Saved rejects (identifier, page, source_text, ...) with ``survives``: whether today's rules would keep them.

    problems: array of the reasons against a row; can_referee(labels, text): a Column that
    tells whether all cited headings are on the page, or the page cannot judge.
    """
    labels = F.filter(F.transform(F.split(F.regexp_replace(F.btrim(F.regexp_replace("source_text", r"(?i)table\s+cell", ""), F.lit(" []")), r"\s*/\s*", "/"), "/"), F.trim), lambda x: x != "")
    x = rejects.join(pages.select("identifier", "page", F.col("text").alias("_text")), ["identifier", "page"], "left").withColumn("_labels", labels)
    return x.withColumn("survives", (F.size(problems) == 0) & can_referee(F.col("_labels"), F.coalesce("_text", F.lit("")))).drop("_text", "_labels")
