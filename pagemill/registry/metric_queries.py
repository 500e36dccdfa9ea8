"""Queries over crawl statistics, metrics, logs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import dedup, fetchlog, frontier, metrics
from pagemill.operators.extract import extract_pages
from pagemill.registry.base import SQL_PARSED, query, sql_words, table
from pagemill.registry.crawl_queries import SQL_FETCH_COUNTERS, SQL_FRONTIER_STATS, fetch_log, page_frontier, page_records, processed_urls
from pagemill.registry.dedup_queries import SQL_ALL_PAGE_KEYS, SQL_PAGE_STATS, judged, keyed_pages, sql_greedy
from pagemill.registry.store_queries import SQL_STORAGE_STATS, stored_pages
from pagemill.schemas import PAGES
from pagemill.session import work_folder
from pagemill.sources import store
from pagemill.sources.tables import events_by_kind, read_logs, spread, without_noise, write_json
from pagemill.streaming import ingest


def crawl_log(spark, folder):
    """Each event as one crawled page: errors, sign-ups as duplicates, the rest stored."""
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("seq"),
        ingest.as_instant(F.col("ts")).alias("ts"),
        F.when(kind == "error", "error").when(kind == "signup", "duplicate").otherwise("stored").alias("outcome"),
        F.when(kind == "error", 0).when(kind == "view", 404).otherwise(200).alias("status"),
        F.when(kind == "error", F.when(F.col("value") < 30, "timeout").otherwise("client")).alias("error_type"),
        F.col("value").alias("response_time"),
        F.octet_length("props").cast("bigint").alias("bytes"),
        (F.col("event_id") * 7 % 1000).alias("queued"),
    )


SQL_LOG = """
log AS (SELECT event_id AS seq, ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'duplicate' ELSE 'stored' END AS outcome,
  CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 404 ELSE 200 END AS status,
  CASE WHEN event_type = 'error' THEN CASE WHEN value < 30 THEN 'timeout' ELSE 'client' END END AS error_type,
  value AS response_time, octet_length(encode(props)) AS bytes, event_id * 7 % 1000 AS queued FROM events),
summary AS (SELECT count(*) AS urls_crawled, count(*) FILTER (outcome = 'stored') AS pages_stored, count(*) FILTER (outcome = 'error') AS errors,
  count(*) FILTER (outcome = 'duplicate') AS duplicates_skipped, CAST(sum(bytes) AS BIGINT) AS total_bytes_downloaded,
  avg(response_time) AS average_response_time, date_diff('microsecond', min(ts), max(ts)) / 1000000.0 AS elapsed_time FROM log)"""


def _rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


@query(f"""
WITH {SQL_LOG}
SELECT urls_crawled, pages_stored, errors, duplicates_skipped, total_bytes_downloaded, round(average_response_time, 6) AS average_response_time,
  round(CAST(elapsed_time AS DOUBLE), 6) AS elapsed_time, round(urls_crawled / (elapsed_time / 60), 6) AS pages_per_minute FROM summary""")
def crawl_summary(spark, folder):
    summary = metrics.crawl_summary(crawl_log(spark, folder))
    return _rounded(summary, "average_response_time", "elapsed_time", "pages_per_minute")


@query(f"""
WITH {SQL_LOG}
SELECT round(CAST(elapsed_time AS DOUBLE), 6) AS runtime_seconds, round(urls_crawled / elapsed_time, 6) AS urls_per_second,
  round(pages_stored / (elapsed_time / 60), 6) AS pages_per_minute FROM summary""")
def summary_rates(spark, folder):
    rates = metrics.summary_rates(metrics.crawl_summary(crawl_log(spark, folder)))
    return _rounded(rates, *rates.columns)


@query(f"""
WITH {SQL_LOG}
SELECT unnest(['crawler_urls_crawled', 'crawler_pages_stored', 'crawler_errors', 'crawler_duplicates_skipped', 'crawler_total_bytes_downloaded',
    'crawler_average_response_time', 'crawler_elapsed_time', 'crawler_pages_per_minute']) AS name,
  unnest([urls_crawled::DOUBLE, pages_stored::DOUBLE, errors::DOUBLE, duplicates_skipped::DOUBLE, total_bytes_downloaded::DOUBLE,
    round(average_response_time, 6), round(elapsed_time::DOUBLE, 6), round(urls_crawled / (elapsed_time / 60), 6)]) AS value FROM summary""")
def bulk_gauges(spark, folder):
    return _rounded(metrics.as_gauges(metrics.crawl_summary(crawl_log(spark, folder))), "value")


def _sql_section(section: str, relation: str, *columns: str) -> str:
    each = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)
    return f"SELECT '{section}' AS section, name, round(value, 6) AS value FROM (SELECT {each} FROM {relation}) UNPIVOT (value FOR name IN ({', '.join(columns)}))"


_CRAWL_FIGURES = ("urls_crawled", "pages_stored", "errors", "duplicates_skipped", "average_response_time", "elapsed_time", "pages_per_minute", "megabytes")
_HASHES = [f"{t}_duplicates" for t in dedup.KEY_TYPES] + [f"total_{t}_hashes" for t in dedup.KEY_TYPES]


@query(f"""
WITH RECURSIVE {SQL_LOG}, {SQL_PAGE_STATS}, {SQL_FRONTIER_STATS.replace(SQL_PARSED + ",", "")}, {SQL_FETCH_COUNTERS}, {SQL_STORAGE_STATS.replace(SQL_PARSED + ",", "")},
crawl AS (SELECT *, urls_crawled / (elapsed_time / 60) AS pages_per_minute, total_bytes_downloaded / 1048576 AS megabytes FROM summary)
{_sql_section("crawl", "crawl", *_CRAWL_FIGURES)}
UNION ALL {_sql_section("frontier", "frontier_stats", "total_queued", "domains_with_urls", "total_processed", "total_domains")}
UNION ALL {_sql_section("fetch", "fetch_counters", "total_requests", "successful_requests", "failed_requests", "robots_blocked", "total_bytes", "total_chars")}
UNION ALL {_sql_section("duplicates", "dedup_stats", "total_checks", *_HASHES)}
UNION ALL {_sql_section("storage", "storage_stats", "total_stored", "total_urls", "without_content", "total_size_bytes")}""")
def final_report(spark, folder):
    """The closing report: all figures of crawl, frontier, fetching, duplicates and storage in one relation."""
    summary = metrics.crawl_summary(crawl_log(spark, folder))
    sections = {
        "crawl": summary.withColumn("megabytes", F.col("total_bytes_downloaded") / 1048576).drop("total_bytes_downloaded"),
        "frontier": frontier.frontier_stats(page_frontier(spark, folder), processed_urls(page_records(spark, folder))),
        "fetch": fetchlog.fetch_counters(fetchlog.read_bodies(fetch_log(spark, folder))),
        "duplicates": dedup.duplicate_stats(judged(keyed_pages(spark, folder))),
        "storage": store.storage_stats(spark, stored_pages(spark, folder)),
    }
    return _rounded(metrics.final_report(sections), "value")


def _points(spark, folder):
    return metrics.metric_points(crawl_log(spark, folder))


_SQL_POINTS = f"""
{SQL_LOG},
points AS (
  SELECT 'urls_crawled_total' AS name, 'counter' AS type, ts, seq, 1.0::DOUBLE AS value, '' AS labels FROM log
  UNION ALL SELECT 'response_time_seconds', 'histogram', ts, seq, response_time, '' FROM log
  UNION ALL SELECT 'http_responses_total', 'counter', ts, seq, 1, 'status_code=' || status FROM log
  UNION ALL SELECT 'queue_size', 'gauge', ts, seq, queued, '' FROM log
  UNION ALL SELECT 'pages_stored_total', 'counter', ts, seq, 1, '' FROM log WHERE outcome = 'stored'
  UNION ALL SELECT 'bytes_downloaded_total', 'counter', ts, seq, bytes, '' FROM log WHERE outcome = 'stored'
  UNION ALL SELECT 'errors_total', 'counter', ts, seq, 1, 'error_type=' || error_type FROM log WHERE outcome = 'error'
  UNION ALL SELECT 'duplicates_skipped_total', 'counter', ts, seq, 1, 'duplicate_type=content' FROM log WHERE outcome = 'duplicate')"""


@query(f"WITH {_SQL_POINTS} SELECT name, type, seq, value, labels FROM points")
def metric_points(spark, folder):
    return _points(spark, folder).select("name", "type", "seq", "value", metrics.label_text(F.col("labels")).alias("labels"))


@query(f"""
WITH {SQL_LOG}, figures AS (SELECT *, urls_crawled / (elapsed_time / 60) AS pages_per_minute FROM summary)
SELECT 'crawler_' || name AS name, 'gauge' AS type, round(value, 6) AS value, 'Crawler stat: ' || name AS description
FROM ({_sql_section("", "figures", *_CRAWL_FIGURES[:-1], "total_bytes_downloaded")})
UNION ALL SELECT 'queue_size', 'gauge', arg_max(queued, (ts, seq))::DOUBLE, 'URLs in queue' FROM log""")
def gauges_described(spark, folder):
    """Gauges of queue and crawl figures with their last values and what they are about."""
    log = crawl_log(spark, folder)
    figures = metrics.gauge_points(metrics.crawl_summary(log), F.current_timestamp(), F.lit(0))
    points = metrics.metric_points(log).filter("type = 'gauge'").unionByName(figures)
    current = _rounded(metrics.current_values(points), "value")
    return current.select("name", F.lit("gauge").alias("type"), "value", metrics.description(F.col("name")).alias("description"))


@query(f"WITH {_SQL_POINTS} SELECT name, labels, sum(value) AS value FROM points WHERE type = 'counter' GROUP BY name, labels")
def errors_by_type(spark, folder):
    """All counters by label set: errors by type, responses by status, duplicates by type."""
    return metrics.counters(_points(spark, folder))


@query(f"WITH {_SQL_POINTS} SELECT name, round(CASE WHEN type = 'counter' THEN sum(value) ELSE arg_max(value, (ts, seq)) END, 6) AS value FROM points GROUP BY name, type")
def gauge_current(spark, folder):
    return _rounded(metrics.current_values(_points(spark, folder)), "value")


@query("""
WITH bounds AS (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0, 'inf'::DOUBLE]) AS le)
SELECT event_type, le, count(*) FILTER (value <= le) AS cumulative_count, count(*) AS total, round(sum(value), 3) AS total_value
FROM events, bounds GROUP BY event_type, le""")
def response_histogram(spark, folder):
    rows = metrics.histogram(table(spark, folder, "events"), "value", ["event_type"])
    return rows.withColumn("total_value", F.round("total_value", 3))


@query(f"""
WITH {_SQL_POINTS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts DESC, seq DESC) AS rank FROM points)
SELECT name, seq, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 1000""")
def metric_history(spark, folder):
    return metrics.recent_points(_points(spark, folder)).select("name", "seq", "value", "rank")


@query(f"""
WITH {_SQL_POINTS}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts DESC, seq DESC) AS rank, sum(value) OVER (PARTITION BY name) AS total FROM points)
SELECT name, type, round(CASE WHEN type = 'counter' THEN max(total) ELSE max(value) FILTER (rank = 1) END, 6) AS current_value, count(*) AS n_points, round(sum(value), 3) AS points_sum,
  round(max(value) FILTER (rank = 100), 6) AS oldest FROM ranked WHERE rank <= 100 GROUP BY name, type""")
def metrics_export(spark, folder):
    """Metrics as JSON with their last 100 points, read back."""
    path = work_folder(spark, "metrics-json")
    write_json(metrics.export_metrics(_points(spark, folder)), path)
    schema = "name string, description string, type string, current_value double, points array<struct<timestamp:timestamp,value:double,labels:map<string,string>>>"
    total = F.aggregate(F.col("points")["value"], F.lit(0.0), lambda a, v: a + v)
    return spark.read.schema(schema).json(path).select(
        "name", "type", F.round("current_value", 6).alias("current_value"), F.size("points").cast("bigint").alias("n_points"),
        F.round(total, 3).alias("points_sum"), F.round(F.get(F.col("points")["value"], F.lit(0)), 6).alias("oldest"),
    )


@query("""
SELECT event_type, unnest([0.5, 0.9, 0.95, 0.99]::DOUBLE[]) AS quantile, unnest(quantile_disc(value, [0.5, 0.9, 0.95, 0.99])) AS value
FROM events GROUP BY event_type""")
def response_percentiles(spark, folder):
    return metrics.percentiles(table(spark, folder, "events"), "value", ["event_type"], [0.5, 0.9, 0.95, 0.99])


@query("""
SELECT unnest([0.5, 0.9, 0.95, 0.99]::DOUBLE[]) AS quantile, unnest(quantile_disc(value, [0.5, 0.9, 0.95, 0.99])) AS value FROM events""")
def response_percentiles_overall(spark, folder):
    return metrics.percentiles(table(spark, folder, "events"), "value", [], [0.5, 0.9, 0.95, 0.99])


@query("""
SELECT event_type, unnest([0.5, 0.9, 0.95, 0.99]::DOUBLE[]) AS quantile, true AS within_tolerance FROM (SELECT DISTINCT event_type FROM events)""")
def response_percentiles_approx(spark, folder):
    """Sketched percentiles, held against the ranks that their values really have."""
    events, wanted, accuracy = table(spark, folder, "events"), [0.5, 0.9, 0.95, 0.99], 1000
    sketched = metrics.approximate_percentiles(events, "value", ["event_type"], wanted, accuracy)
    each = sketched.select("event_type", F.posexplode("values").alias("at", "estimate"))
    ranks = events.join(each, "event_type").groupBy("event_type", "at").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < F.col("estimate")).alias("below"), F.count_if(F.col("value") <= F.col("estimate")).alias("upto"),
    )
    quantile = F.get(F.array(*map(F.lit, wanted)), F.col("at"))
    off = F.ceil(F.col("n") / accuracy)
    within = (F.col("below") - off <= quantile * F.col("n")) & (quantile * F.col("n") <= F.col("upto") + off)
    return ranks.select("event_type", quantile.alias("quantile"), within.alias("within_tolerance"))


# --- logs, made from the events --------------------------------------------


def _log_files(spark, folder):
    """Each event as a line of a structured log, written as text."""
    kind = F.col("event_type")
    line = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.when(kind == "error", "ERROR").when(kind == "view", "DEBUG").otherwise("INFO").alias("level"),
        F.when(kind == "signup", "urllib3.connectionpool").otherwise("crawler.fetch").alias("logger"),
        F.when(kind == "view", F.when(F.col("value") < 10, "New Connection Pool opened").otherwise("page seen"))
        .otherwise(F.concat(F.lit("event "), kind)).alias("message"),
        F.when(kind == "click", "url_event").when(kind == "purchase", "crawler_stat").alias("event_type"),
        F.col("value").alias("stat_value"),
        F.col("event_id").cast("int").alias("line"),
    )
    path = work_folder(spark, "logs")
    lines = table(spark, folder, "events").select(F.to_json(line).alias("value"))
    broken = table(spark, folder, "events").filter(F.col("event_type") == "error").select(F.lit("not a record").alias("value"))
    lines.unionByName(broken).write.text(path)
    return path


@query("""SELECT CAST(event_id AS INTEGER) AS line, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
  value AS stat_value, ts FROM events""")
def log_records(spark, folder):
    rows = read_logs(spark, _log_files(spark, folder))
    return rows.select("line", "level", "stat_value", ingest.without_zone(F.col("ts")).alias("ts"))


@query("SELECT CAST(event_id AS INTEGER) AS line FROM events WHERE event_type <> 'signup' AND NOT (event_type = 'view' AND value < 10)")
def log_noise_filter(spark, folder):
    return without_noise(read_logs(spark, _log_files(spark, folder))).select("line")


@query("""SELECT CASE event_type WHEN 'click' THEN 'url_event' ELSE 'crawler_stat' END AS event_type, 'INFO' AS level, count(*) AS records
FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1""")
def log_events(spark, folder):
    return events_by_kind(read_logs(spark, _log_files(spark, folder)))


# --- streams ---------------------------------------------------------------


_SQL_TOTALS = """
totals AS (SELECT *, sum(crawled) OVER w AS total_crawled, sum(stored) OVER w AS total_stored, sum(errors) OVER w AS total_errors,
    sum(duplicates) OVER w AS total_duplicates, min(window_start) OVER w AS start, sum(spent) OVER w AS total_spent, sum(added) OVER w AS total_added
  FROM windows WINDOW w AS (ORDER BY window_start))"""


def _sql_windows(interval: str) -> str:
    return f"""
windows AS (SELECT time_bucket(INTERVAL {interval}, ts) AS window_start, count(*) AS crawled,
    count(*) FILTER (event_type NOT IN ('error', 'signup')) AS stored, count(*) FILTER (event_type = 'error') AS errors,
    count(*) FILTER (event_type = 'signup') AS duplicates, avg(value) AS mean, sum(value) AS spent, sum(event_id % 3) AS added FROM events GROUP BY 1)"""


@query(f"""
WITH {_sql_windows("30 SECOND")}, {_SQL_TOTALS}
SELECT window_start, crawled, stored, errors, duplicates, crawled * 2.0::DOUBLE AS pages_per_minute, round(mean, 6) AS average_response_time,
  CAST(total_crawled AS BIGINT) AS total_crawled, CAST(total_stored AS BIGINT) AS total_stored, CAST(total_errors AS BIGINT) AS total_errors,
  CAST(total_duplicates AS BIGINT) AS total_duplicates, round(total_crawled / ((epoch(window_start) - epoch(start) + 30) / 60), 6) AS average_pages_per_minute,
  round(total_spent, 3) AS time_so_far, CAST(500 + total_added - total_crawled AS BIGINT) AS queue_size FROM totals""")
def progress_30s(spark, folder):
    """Every 30 seconds: the window's figures, totals so far, and the queue, which held 500 URLs at the start."""
    log = crawl_log(spark, folder).withColumn("added", F.col("seq") % 3)
    rows = ingest.with_totals(ingest.progress(log), queued=500).drop("added")
    time_so_far = F.round(F.col("average_time_so_far") * F.col("total_crawled"), 3)
    rows = rows.withColumns({"window_start": ingest.without_zone(F.col("window_start")), "time_so_far": time_so_far}).drop("average_time_so_far")
    return _rounded(rows, "average_response_time", "average_pages_per_minute")


def _event_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    events = ingest.stream_pages(spark, ingest.table_path(folder, "events"), schema=schema)
    kind = F.col("event_type")
    return events.select(
        ingest.as_instant(F.col("ts")).alias("ts"), "user_id", (F.col("event_id") % 3).alias("added"),
        F.when(kind == "error", "error").when(kind == "signup", "duplicate").otherwise("stored").alias("outcome"),
        F.col("value").alias("response_time"),
    )


@query(f"""
WITH {_sql_windows("1 HOUR")}, {_SQL_TOTALS}
SELECT window_start, crawled, errors, CAST(total_crawled AS BIGINT) AS total_crawled, CAST(total_errors AS BIGINT) AS total_errors,
  CAST(500 + total_added - total_crawled AS BIGINT) AS queue_size FROM totals""")
def stream_progress(spark, folder):
    """Hourly progress of the event stream with totals; later results of a window replace earlier ones."""
    path = work_folder(spark, "progress")
    ingest.progress_stream(_event_stream(spark, folder), path, work_folder(spark, "progress-state"), 3600, "1 hour").awaitTermination()
    rows = ingest.read_progress(spark, path, 3600, queued=500)
    return rows.select(
        ingest.without_zone(F.col("window_start")).alias("window_start"), "crawled", "errors", "total_crawled", "total_errors", "queue_size"
    )


@query("SELECT DISTINCT user_id FROM events")
def stream_dedup_one_key(spark, folder):
    """One record per user within the retention time."""
    path = work_folder(spark, "first-events")
    kept = ingest.dedup_one_key(_event_stream(spark, folder), "user_id", "ts")
    kept.writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", work_folder(spark, "first-events-state")
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select("user_id")


@query(f"WITH {SQL_PARSED} SELECT page_id, title, CAST({sql_words('content')} AS INTEGER) AS word_count, len(links) AS n_links FROM parsed")
def stream_ingest(spark, folder):
    path = work_folder(spark, "stream-records")
    pages = ingest.stream_pages(spark, ingest.table_path(folder, "pages"))
    ingest.extract_stream(pages, path, work_folder(spark, "stream-records-state")).awaitTermination()
    return spark.read.parquet(path).select("page_id", "title", "word_count", F.size("links").cast("bigint").alias("n_links"))


@query(f"""
WITH RECURSIVE {SQL_ALL_PAGE_KEYS}, {sql_greedy('all_page_keys', 'url_key, content_key, fuzzy_key')}
SELECT id, url FROM walk JOIN pages ON page_id = id WHERE kept""")
def stream_dedup(spark, folder):
    """Pages kept by greedy deduplication over a stream of several batches, with keys merged between them."""
    source = work_folder(spark, "page-files")
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    bounds = [pages.agg(F.max("page_id")).first()[0] * k // _BATCHES for k in range(1, _BATCHES)]
    part = sum((F.col("page_id") > b).cast("int") for b in bounds)
    kept, keys, state = work_folder(spark, "kept-pages"), work_folder(spark, "kept-keys"), work_folder(spark, "kept-state")
    for k in range(_BATCHES):
        # Each batch arrives as files for all cores when its predecessor has ended: its pages follow those of the batch before.
        spread(pages.filter(part == k), "page_id").write.mode("append").parquet(source)
        records = extract_pages(ingest.stream_pages(spark, source, schema=PAGES)).select(F.col("page_id").alias("id"), "url", "title", "content")
        ingest.dedup_stream(records, kept, keys, state, "id", "id", fan_in=2).awaitTermination()
    return spark.read.parquet(kept).select("id", "url")


_BATCHES = 3
