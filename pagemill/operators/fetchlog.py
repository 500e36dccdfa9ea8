"""Fetch records: content filters, outcomes and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import decode_body
from pagemill.functions.values import (
    ERROR_NON_TEXT, ERROR_ROBOTS, ERROR_TIMEOUT, MAX_BODY_BYTES, TEXT_TYPES,
)


def is_text_content(content_type: Column) -> Column:
    """One of the text types occurs in the header; a missing header is no text."""
    header = F.lower(F.coalesce(content_type, F.lit("")))
    hit = F.lit(False)
    for text_type in TEXT_TYPES:
        hit = hit | F.contains(header, F.lit(text_type))
    return hit


def within_size_limit(body: Column, content_length: Column | None = None, limit: int = MAX_BODY_BYTES) -> Column:
    ok = F.octet_length(body) <= limit
    if content_length is not None:
        ok = ok & (F.coalesce(content_length, F.lit(0)) <= limit)
    return ok


def read_bodies(fetches: DataFrame) -> DataFrame:
    """Adds ``content``: text of bodies that are text and within the limit.

    The header and size tests run before the body is decoded.  Expects
    ``content_type``, ``charset``, ``body`` and ``error``; ``content_length``
    is optional.
    """
    length = F.col("content_length") if "content_length" in fetches.columns else None
    usable = (
        F.col("error").isNull()
        & is_text_content(F.col("content_type"))
        & within_size_limit(F.col("body"), length)
    )
    staged = fetches.withColumn("_body", F.when(usable, F.col("body")))
    error = F.when(
        F.col("error").isNull() & ~is_text_content(F.col("content_type")), F.lit(ERROR_NON_TEXT)
    ).otherwise(F.col("error"))
    return (
        staged.withColumn("content", decode_body(F.col("_body"), F.col("charset")))
        .withColumn("error", error)
        .drop("_body")
    )


def is_success() -> Column:
    """Fetched without error and with content; the status code does not matter."""
    return F.col("error").isNull() & (F.coalesce(F.col("content"), F.lit("")) != "")


def outcome() -> Column:
    """Class of a fetch record from its ``error`` and ``content``."""
    error = F.col("error")
    return (
        F.when(is_success(), F.lit("ok"))
        .when(error.isNull(), F.lit("empty"))
        .when(error == ERROR_ROBOTS, F.lit("robots_blocked"))
        .when(error == ERROR_NON_TEXT, F.lit("non_text"))
        .when(error == ERROR_TIMEOUT, F.lit("timeout"))
        .when(F.startswith(error, F.lit("Client error")), F.lit("client_error"))
        .otherwise(F.lit("unexpected_error"))
    )


def with_outcome(fetches: DataFrame) -> DataFrame:
    return fetches.withColumn("outcome", outcome())


def fetch_counters(fetches: DataFrame) -> DataFrame:
    """One row of fetch counters.

    Records blocked by robots rules are no requests; non-text and empty
    records are neither successful nor failed.  Bytes are UTF-8 bytes.
    """
    o = F.col("outcome")
    return with_outcome(fetches).agg(
        F.count_if(o != "robots_blocked").alias("total_requests"),
        F.count_if(o == "ok").alias("successful_requests"),
        F.count_if(o.isin("timeout", "client_error", "unexpected_error")).alias("failed_requests"),
        F.count_if(o == "robots_blocked").alias("robots_blocked"),
        F.coalesce(F.sum(F.when(o == "ok", F.octet_length("content"))), F.lit(0)).cast("bigint").alias("total_bytes"),
        F.coalesce(F.sum(F.when(o == "ok", F.length("content"))), F.lit(0)).cast("bigint").alias("total_chars"),
    )
