"""Replay of a crawl over stored pages, level by level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.urls import normalize_url
from pagemill.functions.values import MAX_DEPTH
from pagemill.operators.dedup import DEFAULT, greedy_dedup, key_rows, with_keys
from pagemill.operators.extract import extract_pages
from pagemill.operators.graph import current_version, link_edges, seed_level, targets
from pagemill.session import cut_lineage, placed_by

_STATES = ("stored", "duplicate", "error")


def page_facts(pages: DataFrame, mode: str = "auto", newest: Sequence[str] = (), **rules) -> DataFrame:
    """What a replay needs of a page, computed once: success, keys and links.

    One row for each normalised address, the newest by ``newest`` (columns of
    ``pages``, the most telling first).  Materialised by URL, so the rounds
    neither read a page text nor move the facts again.  A page without content
    counts as a failed fetch.
    """
    ok = F.coalesce(F.col("html"), F.lit("")) != ""
    if "error" in pages.columns:
        ok = ok & F.col("error").isNull()
    at = pages.withColumns({"url": normalize_url(F.col("url")), "ok": ok})
    columns = ["url", "ok", "links", *(f"{t}_key" for t in DEFAULT)]
    facts = with_keys(extract_pages(at, mode, **rules)).select(*columns, *(F.col(c).alias(f"_newest{i}") for i, c in enumerate(newest)))
    return placed_by(current_version(facts, [f"_newest{i}" for i in range(len(newest))]).select(columns), "url", "page-facts")


def crawl_replay(
    facts: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH, follow_duplicate_links: bool = False
) -> DataFrame:
    """One row per URL the crawl meets: ``url, depth, parent_url, state``.

    Pages of a level are taken in URL order.  A duplicate of a stored page is
    neither stored nor followed; a URL without a usable page is an error.
    Within a level and against earlier levels only stored pages count as
    seen.
    """
    level = seed_level(seeds)
    results, seen = None, None
    for depth in range(max_depth + 1):
        fetched = cut_lineage(level.join(facts, "url", "left"))
        usable = fetched.filter(F.coalesce("ok", F.lit(False)))
        judged = greedy_dedup(usable, "url", DEFAULT, "url", seen).select("url", "kept")
        state = (
            F.when(F.col("kept"), F.lit("stored")).when(~F.col("kept"), F.lit("duplicate")).otherwise(F.lit("error"))
        )
        done = cut_lineage(fetched.join(judged, "url", "left").withColumn("state", state))
        rows = done.select("url", "depth", "parent_url", "state")
        results = rows if results is None else results.unionByName(rows)
        if depth == max_depth:
            break
        stored = done.filter(F.col("state") == "stored")
        keys = key_rows(stored, DEFAULT, carry=()).distinct()
        seen = keys if seen is None else seen.unionByName(keys)
        followed = done.filter(F.col("state").isin("stored", "duplicate")) if follow_duplicate_links else stored
        level = cut_lineage(
            targets(link_edges(followed, "depth")).join(results.select("url"), "url", "left_anti")
        )
        if level.isEmpty():
            break
    return results


def replay_summary(replayed: DataFrame) -> DataFrame:
    return replayed.groupBy("depth").agg(
        F.count(F.lit(1)).alias("crawled"),
        *[F.count_if(F.col("state") == s).alias(s) for s in _STATES],
    )
