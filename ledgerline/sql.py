"""Scalar functions for SQL: register(spark) publishes them by name."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import numerals, quotes
from ledgerline.operators import places, records, repairs

#: SQL bodies of temporary functions: name, arguments, body.
BODIES = (
    ("ll_slug", "x STRING", "trim(BOTH '-' FROM regexp_replace(lower(coalesce(x, '')), '[^a-z0-9]+', '-'))"),
    ("ll_haversine_km", "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE", "2 * 6371 * asin(sqrt(least(1, pow(sin((radians(c) - radians(a)) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin((radians(d) - radians(b)) / 2), 2))))"),
    ("ll_values_match", "a DOUBLE, b DOUBLE", "coalesce(abs(a - b) <= 0.01 * greatest(abs(a), abs(b)), a IS NULL AND b IS NULL)"),
    ("ll_wilson_low", "k DOUBLE, n DOUBLE", "greatest(0, (k / n + 1.9208 / n) / (1 + 3.8416 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n)) / (1 + 3.8416 / n))"),
    ("ll_wilson_high", "k DOUBLE, n DOUBLE", "least(1, (k / n + 1.9208 / n) / (1 + 3.8416 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n)) / (1 + 3.8416 / n))"),
)


#: Vectorised functions: name, result, Python function of one text.
TEXT_FUNCTIONS = (
    ("ll_words_to_number", "double", lambda x: numerals.words_to_number(x) if x else None),
    ("ll_evidence_tokens", "array<string>", lambda x: [t for t, _, _ in quotes.tokens(x or "")]),
    ("ll_place_key", "string", places.folded_name),
    ("ll_term_key", "string", records.term_key),
    ("ll_readable", "string", lambda x: repairs.human_number(float(x)) if x else ""),
)


def register(spark: SparkSession) -> list[str]:
    """Publish the scalar functions to SQL; returns their names."""
    for name, args, body in BODIES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURN {body}")
    for name, result, function in TEXT_FUNCTIONS:
        spark.udf.register(name, _vectorised(function, result))

    def value_in_quote(value: pd.Series, quote: pd.Series) -> pd.Series:
        return pd.Series([quotes.value_in_quote(None if pd.isna(v) else float(v), q or "")[0] for v, q in zip(value, quote, strict=True)])

    spark.udf.register("ll_value_in_quote", F.pandas_udf(value_in_quote, "string"))
    return [b[0] for b in BODIES] + [t[0] for t in TEXT_FUNCTIONS] + ["ll_value_in_quote"]


def _vectorised(function, result: str):
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: function(None if v is None else v))

    return F.pandas_udf(run, result)
