"""Claims, slots, flags, and merging of contributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import evidence_tokens


def first_wins(rows: DataFrame, key: str, ord_: str) -> DataFrame:
    """One row for each key, the one that came first; ties by the whole row."""
    rest = [c for c in rows.columns if c not in (key, ord_)]
    return rows.groupBy(key).agg(F.min(F.struct(ord_, *rest)).alias("m")).select(key, "m.*")


def fresh(incoming: DataFrame, existing: DataFrame, key: str, ord_: str) -> DataFrame:
    """Rows of a bundle that are not there yet, each key once."""
    return first_wins(incoming.join(existing.select(key), key, "left_anti"), key, ord_)


def slots(standings: DataFrame, slot: str = "slot") -> DataFrame:
    """State of each slot from standings (slot, value, verified, identifier, page, quote).

    settled: one value among the verified; unsupported: none verified; undistinguished:
    several values that one page lists, each with a quote of its own; else contested.
    """
    ok = F.col("verified")
    page = F.struct("identifier", "page")
    x = standings.groupBy(slot).agg(
        F.count("*").alias("claims"),
        F.count_if(ok).alias("verified"),
        F.count_distinct(F.when(ok, F.col("value"))).alias("n_values"),
        F.count_distinct(F.when(ok, page)).alias("pages"),
        F.count_distinct(F.when(ok, F.array_join(evidence_tokens("quote"), chr(31)))).alias("quotes"),
    )
    state = F.when(F.col("verified") == 0, "unsupported").when(F.col("n_values") <= 1, "settled").when((F.col("pages") == 1) & (F.col("quotes") == F.col("verified")), "undistinguished").otherwise("contested")
    return x.withColumn("state", state)


def most_flagged(flags: DataFrame, claims: DataFrame, limit: int = 10) -> DataFrame:
    """Slots with the most flags: flags (claim_id) of unknown claims are dropped."""
    x = flags.join(claims.select("claim_id", "slot"), "claim_id").groupBy("slot").agg(F.count("*").alias("n_flags"))
    return x.orderBy(F.desc("n_flags"), "slot").limit(limit)


def round_robin(rows: DataFrame, group: str, order: str, limit: int = 60) -> DataFrame:
    """The first rows of each group in turn, then the second ones, and so on."""
    x = rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    return x.orderBy("turn", group, order).limit(limit)


def verdict_counts(standings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, counts by state (verified, unchecked, unsupported, failed) and whether all of it is accepted."""
    n = {s: F.count_if(F.col("state") == s).alias(s) for s in ("verified", "unchecked", "unsupported", "failed")}
    return standings.groupBy(*keys).agg(*n.values()).withColumn("accepted", (F.col("failed") == 0) & (F.col("verified") > 0))
