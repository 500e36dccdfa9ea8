"""The crawl frontier as a table: enqueueing, ordering, politeness, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.urls import url_domain
from pagemill.functions.values import (
    POLITENESS_DELAY, PRIORITY_HIGH, PRIORITY_LOW, RETRY_ATTEMPTS,
)
from pagemill.operators.selection import first_rows
from pagemill.operators.skew import rank_in_group, top_k_per_group
from pagemill.session import written

def tasks(
    urls: DataFrame, depth: int | Column, priority: int | Column, parent_url: Column | None = None,
    discovered_time: Column | None = None, seq: Column | None = None,
) -> DataFrame:
    """Frontier rows for a relation with ``url``; with ``seq``, a unique integer, in queue order."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return urls.select(
        "url",
        url_domain(F.col("url")).alias("domain"),
        as_column(depth).cast("int").alias("depth"),
        as_column(priority).cast("int").alias("priority"),
        (F.lit(None) if parent_url is None else parent_url).cast("string").alias("parent_url"),
        (F.lit(None) if discovered_time is None else discovered_time).cast("timestamp").alias("discovered_time"),
        F.lit(0).alias("retry_count"),
        *([] if seq is None else [seq.cast("bigint").alias("seq")]),
    )


def seed_tasks(seeds: DataFrame, frontier: DataFrame | None = None) -> DataFrame:
    """Seeds at depth 0 with high priority; none if the frontier holds anything."""
    rows = tasks(seeds.select("url").distinct(), 0, PRIORITY_HIGH)
    if frontier is not None and not frontier.isEmpty():
        return rows.limit(0)
    return rows


def new_tasks(candidates: DataFrame, processed: DataFrame, frontier: DataFrame | None = None) -> DataFrame:
    """Candidates not yet processed (nor queued), one row per URL.

    Of several candidates for a URL the one with least depth, then highest
    priority, then least parent counts.  Rows of one URL are combined before
    the shuffle.
    """
    best = F.struct(
        F.col("depth"), (-F.col("priority")).alias("neg_priority"), F.col("parent_url"),
        F.col("discovered_time"), F.col("retry_count"), F.col("domain"),
    )
    merged = candidates.groupBy("url").agg(F.min(best).alias("b")).select(
        "url", "b.domain", "b.depth", (-F.col("b.neg_priority")).cast("int").alias("priority"),
        "b.parent_url", "b.discovered_time", "b.retry_count",
    )
    out = merged.join(processed.select("url"), "url", "left_anti")
    if frontier is not None:
        out = out.join(frontier.select("url"), "url", "left_anti")
    return out


def count_added(candidates: DataFrame, processed: DataFrame, frontier: DataFrame | None = None) -> DataFrame:
    return new_tasks(candidates, processed, frontier).agg(F.count(F.lit(1)).alias("added"))


def add_to_set(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows to append to a set-valued table: new keys it does not hold."""
    return new.select(key).distinct().join(existing.select(key), key, "left_anti")


def domain_heads(frontier: DataFrame) -> DataFrame:
    """Head of every domain queue: highest priority, then first in (``seq``).

    An aggregate with map-side combine: a domain with a third of all rows
    costs its tasks one row each.
    """
    order = F.struct((-F.col("priority")).alias("p"), F.col("seq").alias("s"))
    head = F.min_by(F.struct(*[c for c in frontier.columns if c != "domain"]), order)
    return frontier.groupBy("domain").agg(head.alias("h")).select("domain", "h.*")


def _seconds(ts: str) -> Column:
    return F.unix_micros(ts) / F.lit(1_000_000.0)


def next_domains(
    frontier: DataFrame, last_access: DataFrame, now: Column, delay: float = POLITENESS_DELAY, k: int | None = 1
) -> DataFrame:
    """Heads of domains whose delay has passed, best first: priority, then idle time.

    A domain never visited is the most idle; ties go by domain.  ``k`` is the
    number wanted, None for all that are due.
    """
    idle = F.unix_micros(now) / F.lit(1_000_000.0) - F.coalesce(_seconds("ts"), F.lit(0.0))
    due = (
        domain_heads(frontier)
        .join(last_access.groupBy("domain").agg(F.max("ts").alias("ts")), "domain", "left")
        .withColumn("idle_seconds", idle)
        .filter(F.col("idle_seconds") >= delay)
        .drop("ts")
    )
    if k is None:
        return due
    return due.orderBy(F.desc("priority"), F.desc("idle_seconds"), "domain").limit(k)


def plan_batch(
    frontier: DataFrame,
    last_access: DataFrame,
    delay: float = POLITENESS_DELAY,
    horizon: float | None = None,
    max_pages: int | None = None,
) -> DataFrame:
    """When each queued URL may be fetched: one per domain and delay.

    ``slot`` counts the URLs of the domain before this one; ``not_before`` is
    in seconds after the epoch for visited domains, else after the start.
    With a ``horizon`` (seconds) only slots that begin within it are planned,
    so the ranking keeps at most horizon/delay rows of a domain.
    ``max_pages`` is as for :func:`within_limits`.
    """
    order = [-F.col("priority"), F.col("seq")]
    seen = last_access.groupBy("domain").agg(F.max("ts").alias("_last"))
    if horizon is not None:
        k = max(1, int(-(-horizon // delay)))
        ranked = top_k_per_group(frontier, ["domain"], order, k, ["seq"]).join(seen, "domain", "left")
    else:
        ranked = rank_in_group(frontier, ["domain"], [-F.col("priority")], "seq", group_facts=seen)
    not_before = F.when(
        F.col("_last").isNotNull(), _seconds("_last") + (F.col("slot") + 1) * F.lit(float(delay))
    ).otherwise(F.col("slot") * F.lit(float(delay)))
    planned = (
        ranked.withColumn("slot", (F.col("rank") - 1).cast("bigint"))
        .withColumn("not_before", not_before)
        .drop("_last", "rank")
    )
    return within_limits(planned, max_pages)


def within_limits(plan: DataFrame, max_pages: int | None = None, max_duration: float | None = None) -> DataFrame:
    """First ``max_pages`` of the plan that start before ``max_duration``; 0 or None is no limit.

    Pages count in the order of their start, then priority, then ``seq``.
    Large limits never meet in one task.
    """
    out = plan.filter(F.col("not_before") < float(max_duration)) if max_duration else plan
    if not max_pages:
        return out
    return first_rows(written(out, "plan"), [F.col("not_before"), -F.col("priority"), F.col("seq")], max_pages)


def depth_filter(frontier: DataFrame, max_depth: int) -> DataFrame:
    return frontier.filter(F.col("depth") <= max_depth)


def retry_transition(attempts: DataFrame, success: Column, max_retries: int = RETRY_ATTEMPTS, retryable: Column | None = None) -> DataFrame:
    """Next state of tried frontier rows: ``state`` is 'processed' or 'queued'.

    A failed row returns to the queue with low priority and one more retry
    until ``max_retries`` are used; then it counts as processed.
    """
    may_retry = F.coalesce(~success, F.lit(True)) & (F.col("retry_count") < max_retries)
    if retryable is not None:
        may_retry = may_retry & retryable
    again = attempts.withColumn("_again", may_retry)
    return (
        again.withColumn("state", F.when(F.col("_again"), "queued").otherwise("processed"))
        .withColumn("retry_count", F.when(F.col("_again"), F.col("retry_count") + 1).otherwise(F.col("retry_count")))
        .withColumn("priority", F.when(F.col("_again"), F.lit(PRIORITY_LOW)).otherwise(F.col("priority")))
        .drop("_again")
    )


def frontier_stats(frontier: DataFrame, processed: DataFrame) -> DataFrame:
    """One row: queued rows, domains with rows, processed URLs, domains ever seen."""
    done = processed.select("url").distinct()
    by_domain = (
        frontier.groupBy("domain").agg(F.count(F.lit(1)).alias("queued"))
        .unionByName(
            done.groupBy(url_domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("processed")),
            allowMissingColumns=True,
        )
        .groupBy("domain").agg(F.sum("queued").alias("queued"), F.sum("processed").alias("processed"))
    )
    return by_domain.agg(
        F.coalesce(F.sum("queued"), F.lit(0)).cast("bigint").alias("total_queued"),
        F.count("queued").alias("domains_with_urls"),
        F.coalesce(F.sum("processed"), F.lit(0)).cast("bigint").alias("total_processed"),
        F.count(F.lit(1)).alias("total_domains"),
    )


def is_empty(frontier: DataFrame) -> bool:
    return frontier.isEmpty()


def empty_flag(frontier: DataFrame) -> DataFrame:
    """:func:`is_empty` as a row, for reports; reads one row at most."""
    return frontier.select(F.lit(1).alias("_")).limit(1).agg((F.count(F.lit(1)) == 0).alias("is_empty"))


def to_json_rows(frontier: DataFrame) -> DataFrame:
    """Frontier rows as JSON text, epoch seconds for the discovery time."""
    row = F.struct(
        "url", "depth", "priority", "parent_url",
        _seconds("discovered_time").alias("discovered_time"), "retry_count",
    )
    return frontier.select(F.to_json(row).alias("task"))


def from_json_rows(rows: DataFrame) -> DataFrame:
    schema = "url string, depth int, priority int, parent_url string, discovered_time double, retry_count int"
    t = F.from_json("task", schema)
    return rows.select(t.alias("t")).select(
        "t.url", url_domain(F.col("t.url")).alias("domain"), "t.depth", "t.priority", "t.parent_url",
        F.timestamp_micros((F.col("t.discovered_time") * 1_000_000).cast("bigint")).alias("discovered_time"),
        F.coalesce("t.retry_count", F.lit(0)).alias("retry_count"),
    )
