"""Catalogue search: scoring, facets, reading plans, effort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import search_tokens

# Weights of a term in a title, a subject and a publisher; the least score of a hit;
# the share of pages worth reading and the seconds one takes.
TITLE, SUBJECT, PUBLISHER, LEAST = 3.0, 2.0, 0.5, 2.0
WORTH, SECONDS = 0.531, 150.0


def score(query: str, title="title", subject="subject", publisher="publisher") -> Column:
    """Terms are matched as parts of words: title 3, any subject 2, publisher one half."""
    terms = sorted({t for t in "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in query).split() if len(t) > 1})
    text = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    subjects = F.lower(F.array_join(F.coalesce(F.col(subject), F.array().cast("array<string>")), "\n"))
    out = F.lit(0.0)
    for t in terms:
        for held, weight in ((text(title), TITLE), (subjects, SUBJECT), (text(publisher), PUBLISHER)):
            out = out + F.when(held.contains(t), F.lit(weight)).otherwise(F.lit(0.0))
    return out


def search(items: DataFrame, query: str, limit: int | None = 50, year: str = "year", ord_: str = "ord") -> DataFrame:
    """Hits by falling score, then year (unknown ones last), then catalogue order."""
    x = items.withColumn("score", score(query)).where(F.col("score") >= LEAST).orderBy(F.desc("score"), F.coalesce(F.col(year), F.lit(9999)), ord_)
    return x.limit(limit) if limit is not None else x


def facets(hits: DataFrame, publishers: int = 8, subjects: int = 12, per_item: int = 4) -> DataFrame:
    """(facet, value, n) over all hits: every year, the most frequent publishers and subjects (ties by text)."""
    from pyspark.sql import Window

    years = hits.where("year is not null").groupBy(F.col("year").cast("string").alias("value")).agg(F.count("*").alias("n")).withColumn("facet", F.lit("year"))

    def top(rows: DataFrame, name: str, k: int) -> DataFrame:
        x = rows.where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
        return x.orderBy(F.desc("n"), "value").limit(k).withColumn("facet", F.lit(name))

    pub = top(hits.select(F.col("publisher").alias("value")), "publisher", publishers)
    sub = top(hits.select(F.explode(F.slice("subject", 1, per_item)).alias("value")), "subject", subjects)
    return years.unionByName(pub).unionByName(sub).select("facet", "value", "n")


def effort(hits: DataFrame, total: int, pages: str = "imagecount") -> DataFrame:
    """pages, pages worth reading and hours that reading ``total`` items would take, from the mean of the hits at hand."""
    mean = F.coalesce(F.avg(pages), F.lit(0.0))
    x = hits.agg(mean.alias("mean"))
    return x.select((F.col("mean") * total).alias("pages"), (F.col("mean") * total * WORTH).alias("worth"), (F.col("mean") * total * WORTH * SECONDS / 3600.0).alias("hours"))


def reading_plan(items: DataFrame, limit: int = 20, ord_: str = "ord") -> DataFrame:
    """Recurring reports first, then by title."""
    recurring = F.col("title").rlike(r"(?i)\b(annual|report|yearbook|survey)\b")
    return items.orderBy(F.when(recurring, 0).otherwise(1), F.lower("title"), ord_).limit(limit)


def matches(title: str | None = None, publisher: str | None = None, years: tuple[int, int] | None = None) -> Column:
    """Predicate of a catalogue scan; with a range, items of no known year are out."""
    out = F.lit(True)
    if title:
        out = out & F.lower("title").contains(title.lower())
    if publisher:
        out = out & F.lower("publisher").contains(publisher.lower())
    if years:
        out = out & F.coalesce(F.substring(F.col("year").cast("string"), 1, 4).try_cast("int").between(*years), F.lit(False))
    return out


__all__ = ["effort", "facets", "matches", "reading_plan", "score", "search", "search_tokens"]
