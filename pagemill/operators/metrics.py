"""Crawl statistics and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from pagemill.functions.values import HISTOGRAM_BUCKETS, METRIC_DESCRIPTIONS, METRIC_EXPORT, METRIC_HISTORY
from pagemill.operators.selection import SMALL, values_at_ranks
from pagemill.operators.skew import top_k_per_group


def crawl_summary(log: DataFrame) -> DataFrame:
    """One row of crawl statistics.

    ``log`` has ``ts``, ``outcome`` (stored, duplicate, error), ``response_time``
    in seconds and ``bytes``.
    """
    elapsed = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / F.lit(1_000_000.0)
    return log.agg(
        F.count(F.lit(1)).alias("urls_crawled"),
        F.count_if(F.col("outcome") == "stored").alias("pages_stored"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicates_skipped"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("total_bytes_downloaded"),
        F.coalesce(F.avg("response_time"), F.lit(0.0)).alias("average_response_time"),
        F.coalesce(elapsed, F.lit(0.0)).alias("elapsed_time"),
    ).withColumn("pages_per_minute", _rate(F.col("urls_crawled"), F.col("elapsed_time") / 60))


def _rate(amount: Column, time: Column) -> Column:
    return F.when(time > 0, amount / time).otherwise(F.lit(0.0))


def summary_rates(summary: DataFrame) -> DataFrame:
    return summary.select(
        F.col("elapsed_time").alias("runtime_seconds"),
        _rate(F.col("urls_crawled"), F.col("elapsed_time")).alias("urls_per_second"),
        _rate(F.col("pages_stored"), F.col("elapsed_time") / 60).alias("pages_per_minute"),
    )


def as_gauges(stats: DataFrame, prefix: str = "crawler_") -> DataFrame:
    """Every numeric column of a one-row result as a gauge ``(name, value)``."""
    numeric = [f.name for f in stats.schema if isinstance(f.dataType, NumericType)]
    wide = stats.select(*[F.col(c).cast("double").alias(f"{prefix}{c}") for c in numeric])
    return wide.unpivot([], [f"{prefix}{c}" for c in numeric], "name", "value")


def final_report(sections: dict[str, DataFrame]) -> DataFrame:
    """One-row results of several areas as rows ``(section, name, value)``."""
    out = None
    for section, stats in sections.items():
        rows = as_gauges(stats, "").select(F.lit(section).alias("section"), "name", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def metric_points(log: DataFrame) -> DataFrame:
    """Metric points of a crawl log: ``ts, seq, status, response_time, outcome, bytes, error_type``.

    One pass; each record gives the points its outcome calls for, and a gauge
    point of the queue where the log has its size, ``queued``.
    """

    def point(name: str, kind: str, value: Column, labels: Column | None = None) -> Column:
        none = F.create_map().cast("map<string,string>")
        return F.struct(
            F.lit(name).alias("name"), F.lit(kind).alias("type"), value.cast("double").alias("value"),
            (none if labels is None else labels).alias("labels"),
        )

    one = F.lit(1.0)
    always = [
        point("urls_crawled_total", "counter", one),
        point("response_time_seconds", "histogram", F.col("response_time")),
        point(
            "http_responses_total", "counter", one,
            F.create_map(F.lit("status_code"), F.col("status").cast("string")),
        ),
    ]
    if "queued" in log.columns:
        always.append(point("queue_size", "gauge", F.col("queued")))
    stored = [
        point("pages_stored_total", "counter", one),
        point("bytes_downloaded_total", "counter", F.col("bytes")),
    ]
    error = [point("errors_total", "counter", one, F.create_map(F.lit("error_type"), F.col("error_type")))]
    duplicate = [
        point("duplicates_skipped_total", "counter", one, F.create_map(F.lit("duplicate_type"), F.lit("content")))
    ]
    points = (
        F.when(F.col("outcome") == "stored", F.array(*always, *stored))
        .when(F.col("outcome") == "error", F.array(*always, *error))
        .when(F.col("outcome") == "duplicate", F.array(*always, *duplicate))
        .otherwise(F.array(*always))
    )
    return log.select("ts", "seq", F.explode(points).alias("p")).select(
        "p.name", "p.type", "ts", "seq", "p.value", "p.labels"
    )


def gauge_points(stats: DataFrame, ts: Column, seq: Column, prefix: str = "crawler_") -> DataFrame:
    """The figures of a one-row result as gauge points, to be added to those of the log."""
    none = F.create_map().cast("map<string,string>")
    return as_gauges(stats, prefix).select("name", F.lit("gauge").alias("type"), ts.alias("ts"), seq.cast("bigint").alias("seq"), "value", none.alias("labels"))


def description(name: Column, prefix: str = "crawler_") -> Column:
    """What a metric is about; null for names that are not known."""
    known = F.create_map(*(F.lit(x) for pair in METRIC_DESCRIPTIONS.items() for x in pair))
    stat = F.concat(F.lit("Crawler stat: "), F.substr(name, F.lit(len(prefix) + 1)))
    return F.when(F.startswith(name, F.lit(prefix)), stat).otherwise(F.try_element_at(known, name))


def label_text(labels: Column) -> Column:
    """Labels as text with sorted keys: groupable, unlike a map."""
    return F.array_join(
        F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
    )


def counters(points: DataFrame) -> DataFrame:
    """Counter totals per name and label set."""
    return (
        points.filter(F.col("type") == "counter")
        .groupBy("name", label_text(F.col("labels")).alias("labels")).agg(F.sum("value").alias("value"))
    )


def current_values(points: DataFrame) -> DataFrame:
    """Value per metric: the running total of a counter, the last value of any other."""
    return _current(points).select("name", "value")


def _current(points: DataFrame) -> DataFrame:
    last, total = F.max_by("value", F.struct("ts", "seq")), F.sum("value")
    return points.groupBy("name", "type").agg(F.when(F.col("type") == "counter", total).otherwise(last).alias("value"))


def histogram(
    values: DataFrame, value: str, keys: Sequence[str] = (), buckets: Sequence[float] = HISTOGRAM_BUCKETS
) -> DataFrame:
    """Cumulative counts per upper bound ``le`` (infinity last), and count and sum."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(buckets)]
    wide = values.groupBy(*keys).agg(
        *counts, F.count(F.col(value)).alias("total"), F.sum(value).alias("total_value")
    )
    rows = [
        F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)
    ] + [F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("n"))]
    return wide.select(
        *keys, F.explode(F.array(*rows)).alias("b"), "total", "total_value"
    ).select(*keys, "b.le", F.col("b.n").alias("cumulative_count"), "total", "total_value")


def recent_points(points: DataFrame, n: int = METRIC_HISTORY) -> DataFrame:
    """The last ``n`` points of every metric, newest first (``rank``)."""
    return top_k_per_group(points, ["name"], [F.desc("ts"), F.desc("seq")], n, ["seq"])


def export_metrics(points: DataFrame, n: int = METRIC_EXPORT) -> DataFrame:
    """One row per metric with its current value and last points, ready for JSON.

    The current value comes from all points, not from those exported.  At most ``n`` points of a metric meet in a row.
    """
    newest_last = (-F.col("rank")).alias("o")
    point = F.struct(newest_last, "ts", "value", F.map_entries("labels").alias("labels"))
    exported = recent_points(points, n).groupBy("name", "type").agg(
        F.transform(
            F.sort_array(F.collect_list(point)),
            lambda x: F.struct(
                x["ts"].alias("timestamp"), x["value"].alias("value"), F.map_from_entries(x["labels"]).alias("labels")
            ),
        ).alias("points"),
    )
    current = _current(points).withColumnRenamed("value", "current_value")
    return current.join(exported, ["name", "type"]).select("name", description(F.col("name")).alias("description"), "type", "current_value", "points")


def percentiles(
    values: DataFrame, value: str, keys: Sequence[str], quantiles: Sequence[float], small: int = SMALL
) -> DataFrame:
    """Exact percentiles (nearest rank) per group, one row per quantile.

    A large group is never sorted in one task, whatever its values: see
    :func:`values_at_ranks`.  Without keys the whole table is one group.
    """
    rank = lambda q: F.greatest(F.ceil(q * F.col("_total")), F.lit(1))
    wanted = F.transform(F.array(*[F.lit(float(q)) for q in quantiles]), lambda q: F.struct(q.alias("target"), rank(q).alias("rank")))
    found = values_at_ranks(values, value, keys, wanted, small)
    return found.select(*keys, F.col("target").alias("quantile"), "value")


def approximate_percentiles(
    values: DataFrame, value: str, keys: Sequence[str], quantiles: Sequence[float], accuracy: int = 10_000
) -> DataFrame:
    """``values``, one for each quantile, whose rank is off by at most 1 / ``accuracy`` of the group's size."""
    return values.groupBy(*keys).agg(
        F.percentile_approx(value, [float(q) for q in quantiles], accuracy).alias("values")
    )
