"""Link graph: edges, one-hop expansion, depth-bounded reachability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.urls import is_valid_url, normalize_url
from pagemill.functions.values import MAX_DEPTH, PRIORITY_NORMAL
from pagemill.operators.skew import exploded
from pagemill.session import cut_lineage


def current_version(rows: DataFrame, newest: Sequence[str | Column], url: str = "url") -> DataFrame:
    """One row for each normalised address, which replaces the stored one: the newest by ``newest``, the most telling first.

    Links name pages by their normalised address, so a page stored with a
    fragment or an upper-case host is found by them only under that.  Of rows
    that agree in all of ``newest`` the one with the larger hash over the whole
    row counts; a null is older than any value.  Spark trims each task to one
    row an address before the shuffle; hand in links and keys rather than page
    texts.
    """
    order = [F.desc_nulls_last(c) if isinstance(c, str) else c.desc_nulls_last() for c in newest]
    at = rows.withColumn(url, normalize_url(F.col(url)))
    content = F.xxhash64(F.to_json(F.struct(*at.columns)))
    latest = Window.partitionBy(url).orderBy(*order, content.desc())
    return at.withColumn("_rn", F.row_number().over(latest)).filter("_rn = 1").drop("_rn")


def seed_level(seeds: DataFrame) -> DataFrame:
    """Level 0 of a crawl: the normalised addresses of the seeds."""
    return cut_lineage(
        seeds.select(normalize_url(F.col("url")).alias("url")).distinct()
        .select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_url"))
    )


def link_edges(records: DataFrame, depth: str | None = None) -> DataFrame:
    """One row per page and link: what a stored page puts into the frontier."""
    child_depth = (F.col(depth) + 1 if depth else F.lit(1)).cast("int")
    edges = exploded(
        records, F.col("links"), "_link", F.col("url").alias("parent_url"), child_depth.alias("depth")
    )
    return edges.select("parent_url", F.col("_link").alias("url"), "depth", F.lit(PRIORITY_NORMAL).alias("priority"))


def outbound_links(records: DataFrame, allowed: Sequence[str] = (), blocked: Sequence[str] = ()) -> DataFrame:
    """Apply the URL rules to the links again."""
    return records.withColumn("links", F.filter("links", lambda u: is_valid_url(u, allowed, blocked)))


def targets(edges: DataFrame) -> DataFrame:
    """Distinct link targets with least depth and parent.  Combined before the
    shuffle, so a page everybody links to costs each task one row."""
    best = F.struct("depth", "parent_url")
    return edges.groupBy("url").agg(F.min(best).alias("b")).select("url", "b.depth", "b.parent_url")


def one_hop(records: DataFrame, processed: DataFrame, depth: str | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """New URLs one link away: targets within the depth bound and not processed."""
    reached = targets(link_edges(records, depth)).filter(F.col("depth") <= max_depth)
    return reached.join(processed.select("url"), "url", "left_anti")


def crawl_depth(links: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Least depth of every URL reachable from the seeds, at most ``max_depth``.

    ``links`` is ``(url, links)`` of stored pages, one row for each normalised
    address (:func:`current_version`); it is joined once per level, so hand it
    in as ``session.placed_by(links, "url")``.  One level per round; URLs
    without a stored page are reached but lead nowhere.  Stops when a level
    is empty.
    """
    level = seed_level(seeds)
    reached = level
    for depth in range(1, max_depth + 1):
        pages = links.join(level.select("url"), "url", "left_semi").withColumn("depth", F.lit(depth - 1))
        level = cut_lineage(
            targets(link_edges(pages, "depth")).join(reached.select("url"), "url", "left_anti")
        )
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    return reached
