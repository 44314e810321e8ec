"""Checking of quoted sentences and values against the pages they cite."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ledgerline.functions import quotes
from ledgerline.functions import text as T

#: Tokens of a seed, for passages that have so many; shorter ones are sought by all their tokens.
WIDTHS = (8, 4, 3, 2, 1)


#: Signs that change what they stand beside.
SIGNS = "<>=%$£€±≤≥"


def _hashed(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _seeded(passages: DataFrame, pages: DataFrame, passage: str, page: str) -> DataFrame | None:
    """Pairs of the columns passage and page that share a passage's seed, from passages (passage, n) and pages (page, t) with hashed tokens; None without a passage."""

    def runs(names: str, w: int) -> Column:
        """Hashes of all runs of w tokens, from the hashes of the tokens."""
        return F.transform(F.sequence(F.lit(0), F.size(names) - w), lambda i: F.xxhash64(*(F.get(names, i + k) for k in range(w))))

    width = F.coalesce(*(F.when(F.size("n") >= w, w) for w in WIDTHS))
    p = passages.withColumn("w", width)
    p = p.withColumn("h", F.coalesce(*(F.when(width == w, F.array_min(runs("n", w))) for w in WIDTHS)))
    found = None
    for w in sorted(r[0] for r in p.select("w").distinct().collect()):
        # no filter on the tokens' number: pushed down, it would tokenise every page twice
        some = pages.select(page, F.explode(F.when(F.size("t") >= w, F.array_distinct(runs("t", w)))).alias("h"))
        some = some.join(p.where(F.col("w") == w).select(passage, "h"), "h").select(passage, page)
        found = some if found is None else found.unionByName(some)
    return found


def containing(passages: DataFrame, pages: DataFrame) -> DataFrame:
    """(passage_id, page_id) where a page holds a passage (passage_id, text) as one run of evidence tokens.

    A passage is sought by one run of its tokens, the longest of WIDTHS that it has
    and of those the one with the least hash, so that common openings are no keys.
    Only (page, hash) is joined; token arrays meet for the pairs that this leaves.
    """
    p = passages.select("passage_id", T.evidence_tokens("text").alias("q")).where(F.size("q") > 0)
    tokens = pages.select("page_id", _hashed(T.evidence_tokens("text")).alias("t"))
    found = _seeded(p.select("passage_id", _hashed(F.col("q")).alias("n")), tokens, "passage_id", "page_id")
    if found is None:
        return passages.select("passage_id").join(pages.select("page_id"), F.lit(False))
    # only pages with a candidate are tokenised again
    pairs = found.distinct().join(p.select("passage_id", "q"), "passage_id").join(pages.select("page_id", "text"), "page_id")
    return pairs.where(T.contains_run(T.evidence_tokens("text"), F.col("q"))).select("passage_id", "page_id").distinct()


def quoted(passages: DataFrame, pages: DataFrame) -> DataFrame:
    """(passage_id, page_id) for each row of passages and of pages (id, text) where the page holds the passage to the letter and no sign stands beside its first place.

    A passage may begin and end inside a word of the page, but the words between its
    first and last blank stand on the page as they are: the seed is taken from those.
    Passages without such a word are compared with every page.  A passage without a
    character is on every page that has a text.
    """
    own = F.xxhash64(F.col("id"), F.col("text"))  # never null, so rows without an id and repeated rows count as they are
    p = passages.select(F.col("passage_id").alias("id"), "text").where("text is not null").select("id", F.col("text").alias("q"), own.alias("pk"))
    d = pages.select(F.col("page_id").alias("id"), "text").where("text is not null").select(F.col("id").alias("page_id"), "text", own.alias("gk"))
    words = F.split("q", r"[ \t\n\x0B\f\r]+")
    p = p.withColumn("n", F.when(F.size(words) > 2, _hashed(F.slice(words, 2, F.size(words) - 2))))
    tokens = d.select("gk", _hashed(F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda x: x != "")).alias("t"))
    found = _seeded(p.where("n is not null").select("pk", "n"), tokens, "pk", "gk")
    p, short = p.where("n is not null").drop("n"), p.where("n is null").drop("n", "pk")
    pairs = short.join(d.drop("gk"), F.col("text").contains(F.col("q")))
    if found is not None:
        pairs = pairs.unionByName(found.distinct().join(p, "pk").join(d, "gk").where(F.col("text").contains(F.col("q"))).drop("pk", "gk"))
    at = F.instr(F.col("text"), F.col("q"))
    other = rf"[^\p{{L}}\p{{N}}{SIGNS}]*"
    before = F.substring(F.col("text"), F.lit(1), at - 1).rlike(rf"[{SIGNS}]{other}\z")
    after = F.substring(F.col("text"), at + F.length("q"), F.length("text")).rlike(rf"^{other}[{SIGNS}]")
    return pairs.where(~(before | after)).select(F.col("id").alias("passage_id"), "page_id")


def verdicts(records: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """records (keys, quote, value) with ``state``, ``why`` and ``matched`` (the span of the page) from pages (keys, text).

    verified: the sentence is on the page and states the value; unchecked: on the page,
    without a value to check; unsupported: nothing to check, or too little; failed: the
    rest.  Readings and claims are judged by this one rule.  Rows leave the join page by
    page, so a worker tokenises a page once for all that cite it.
    """
    held = records.columns
    x = records.join(pages.select(*keys, F.col("text").alias("_page")), keys, "left")
    names = [*held, "state", "why", "matched"]
    schema = T_.StructType(list(records.schema.fields)).add("state", "string").add("why", "string").add("matched", "string")
    cited = F.lit(True)
    for k in keys:
        cited = cited & F.col(k).isNotNull()
    x = x.select(*(F.col(c) for c in held), F.when(cited & (F.coalesce("quote", F.lit("")) != ""), F.col("quote")).alias("_quote"), F.col("value").cast("double").alias("_value"), "_page")

    def run(frames):
        for f in frames:
            out = []
            for quote, value, page in zip(f["_quote"], f["_value"], f["_page"], strict=True):
                if quote is None:
                    out.append(("unsupported", "no page or no quoted sentence -- nothing to check", None))
                else:
                    out.append(quotes.judge(quote, None if pd.isna(value) else float(value), page))
            told = pd.DataFrame(out, columns=["state", "why", "matched"], index=f.index)
            yield pd.concat([f[held], told], axis=1)[names]

    return x.mapInPandas(run, schema)


def value_state(value, quote) -> Column:
    """Struct of state (ok, unchecked, failed) and why: whether a sentence states a value."""

    def run(v: pd.Series, q: pd.Series) -> pd.DataFrame:
        rows = [quotes.value_in_quote(None if pd.isna(a) else float(a), b or "") for a, b in zip(v, q, strict=True)]
        return pd.DataFrame(rows, columns=["state", "why"])

    return F.pandas_udf(run, "state string, why string")(value, quote)


def grounded_condition(condition, quote) -> Column:
    """The condition if its words stand in the quoted sentence in a row, else null."""
    condition = F.col(condition) if isinstance(condition, str) else condition
    quote = F.col(quote) if isinstance(quote, str) else quote
    mark = F.lit(chr(31))
    flat = lambda c: F.concat(mark, F.array_join(T.evidence_tokens(c), chr(31)), mark)
    return F.when((F.size(T.evidence_tokens(condition)) > 0) & flat(quote).contains(flat(condition)), condition)


def unit_holds_count(unit) -> Column:
    """Whether a unit field carries a number that no letter leads, such as ``3 pumps``."""
    return F.coalesce((F.col(unit) if isinstance(unit, str) else unit).rlike(r"(?<![A-Za-z])\d"), F.lit(False))
