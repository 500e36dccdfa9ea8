"""Pages to a deduplicated per-domain summary: the shortest useful pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import content_hash
from pagemill.functions.urls import canonical_url_key, url_domain
from pagemill.operators.dedup import keep_first
from pagemill.operators.extract import extract_pages


def domain_summary(pages: DataFrame) -> DataFrame:
    """Pages, words and distinct links per domain, after dropping repeated URLs and contents."""
    records = extract_pages(pages).select(
        F.col("page_id").alias("id"),
        url_domain(F.col("url")).alias("domain"),
        canonical_url_key(F.col("url")).alias("url_key"),
        content_hash(F.col("content")).alias("content_key"),
        "word_count",
        F.size("links").alias("n_links"),
    )
    unique = keep_first(keep_first(records, "url_key", "id"), "content_key", "id")
    return unique.groupBy("domain").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("word_count").cast("bigint").alias("words"),
        F.sum("n_links").cast("bigint").alias("links"),
    )
