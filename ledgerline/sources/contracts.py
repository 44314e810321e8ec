"""Data contracts of what stays outside the engine: network access, model calls, pages of HTML, batch operation.

The engine neither calls a model nor fetches a page.  It takes the results of those
that do as tables, and gives them tables; these are their schemas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

CONTRACTS = {
    # catalogue and items as a scraper leaves them
    "index_item": "identifier string, title string, year string, date string, language array<string>, subject array<string>, collection array<string>, publisher array<string>, imagecount long, downloads long, item_size long",
    "index_page": "cursor string, fetched_at timestamp, items array<string>",
    "item_metadata": "identifier string, fetched_at timestamp, files array<struct<name: string, format: string, size: long>>",
    "http_fetch": "url string, status int, attempts int, waited_seconds double, body binary, fetched_at timestamp",
    "provider_fetch": "provider string, url string, status int, cached boolean, body string, snapshot_digest string, fetched_at timestamp",
    "image_service": "identifier string, base_url string, resolved_at timestamp, error string",
    # model calls and what they propose, before the gates
    "model_request": "request_id string, identifier string, page int, path string, prompt string, vocabulary array<string>, model string",
    "model_answer": "request_id string, raw string, seconds double, error string",
    "candidate": "request_id string, identifier string, page int, path string, row_label string, column_label string, kind string, parameter string, value double, unit string, qualifier string, stream string, place string, facility string, period string, condition string, source_text string, model_confidence double",
    "rejected_candidate": "request_id string, identifier string, page int, why string, candidate string",
    "question": "question_id string, place string, asked_at timestamp, peer_tag string",
    "tool_call": "call_id string, tool string, arguments string, result string",
    # jobs and receipts
    "read_job": "job_id string, place string, state string, started_at timestamp, ended_at timestamp, log array<string>",
    "batch_receipt": "place string, selection_sha256 string, report_identifiers array<string>, pages_attempted array<string>, n_records long, completed_at timestamp",
    "request_audit": "received_at timestamp, host string, origin string, bytes long, admitted boolean, why string",
    # what pages and charts are drawn from
    "chart_point": "place string, label string, facility string, stream string, year int, value double, unit string, page_url string, quote string",
    "map_feature": "place string, lat double, lon double, first_year int, last_year int, silent_since int, extracted boolean, reported array<int>",
    "score_line": "identifier string, page int, gold long, got long, matched long, precision double, recall double, kind_accuracy double, stream_accuracy double",
    "form_answer": "form string, field string, value string, problem string",
    "prompt_trial": "trial string, prompt string, page string, matched long, missed long, spurious long, seconds double",
}


def empty(spark, name: str) -> DataFrame:
    """A table of a contract without rows."""
    return spark.createDataFrame([], CONTRACTS[name])


def violations(df: DataFrame, name: str) -> list[str]:
    """What keeps a table from a contract: columns that are missing or of another type; further columns are allowed."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    want = {f.name: f.dataType.simpleString() for f in empty(df.sparkSession, name).schema.fields}
    return [f"{n}: missing" if n not in have else f"{n}: {have[n]}, not {k}" for n, k in want.items() if have.get(n) != k]
