"""Content table, metrics, logs and streams."""

import datetime
import json
import math
import random

from pyspark.sql import functions as F

from pagemill.operators import dedup as D
from pagemill.operators import metrics
from pagemill.operators.extract import extract_pages
from pagemill.registry import metric_queries
from pagemill.schemas import METRIC_POINTS, PAGES
from pagemill.sources import store
from pagemill.sources.tables import events_by_kind, read_logs, read_pages, seed_urls, without_noise, write_json
from pagemill.streaming import ingest

DAY = datetime.datetime(2024, 1, 1)


def test_store_round_trip(spark, small, tmp_path):
    path = str(tmp_path / "content")
    pages = read_pages(spark, f"{small}/pages.parquet")
    records = extract_pages(pages).drop("page_id")
    store.store_content(records, path, F.lit(DAY))
    url = pages.first().url
    changed = records.filter(F.col("url") == url).withColumn("title", F.lit("new"))
    store.store_content(changed, path, F.lit(DAY + datetime.timedelta(days=1)))
    assert store.read_content(spark, path).count() == 50
    one = store.get_content(spark, path, url)
    assert one.first().title == "new" and one.count() == 1
    assert store.get_content(spark, path, "http://none/").count() == 0
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(hash_prefix" in plan and "PushedFilters: [IsNotNull(url_hash), EqualTo(url_hash" in plan
    many = store.get_contents(spark, path, seed_urls(spark, [url, "http://none/"]))
    assert [r.title for r in many.collect()] == ["new"]
    exists = store.content_exists(spark, path, seed_urls(spark, [url, "http://none/"]))
    assert {r.url: r.stored for r in exists.collect()} == {url: True, "http://none/": False}
    stats = store.storage_stats(spark, path).first()
    assert (stats.total_stored, stats.total_urls) == (51, 50) and stats.total_size_bytes > 10_000
    assert store.url_index(spark, path).filter(F.col("status") == "stored").count() == 50
    target = str(tmp_path / "compact")
    store.compact(spark, path, target)
    assert spark.read.schema(store.CONTENT).parquet(target).count() == 50
    columns = [c for c in records.columns if c not in ("parse_error", "schema_org_data")]
    same = store.as_records(store.read_content(spark, path)).filter(F.col("url") != url)
    as_text = lambda df: sorted(str(r) for r in df.select(*columns).collect())
    assert as_text(same) == as_text(records.filter(F.col("url") != url))


def test_structured_data_survives_storage(spark, tmp_path):
    html = '<main>m</main><script type="application/ld+json">{"@type":"A","n":{"x":[1]}}</script>'
    records = extract_pages(spark.createDataFrame([("http://a/", html)], "url string, html string"))
    store.store_content(records, str(tmp_path / "c"))
    back = store.get_content(spark, str(tmp_path / "c"), "http://a/").first()
    assert {k: [json.loads(o) for o in v] for k, v in back.schema_org_data.items()} == {"A": [{"@type": "A", "n": {"x": [1]}}]}


def test_metrics(spark):
    rng = random.Random(2)
    rows = [("g", "gauge", DAY, i, float(i), {"b": "1", "a": "2"}) for i in range(1500)]
    rows += [("c", "counter", DAY + datetime.timedelta(seconds=i), i, 1.0, {"a": "2", "b": "1"} if i % 2 else {"b": "1", "a": "2"}) for i in range(9)]
    df = spark.createDataFrame(rows, METRIC_POINTS)
    assert {r.name: r.value for r in metrics.current_values(df).collect()} == {"g": 1499.0, "c": 9.0}
    assert [tuple(r) for r in metrics.counters(df).collect()] == [("c", "a=2,b=1", 9.0)]
    recent = metrics.recent_points(df).filter("name = 'g'")
    assert recent.count() == 1000 and recent.agg(F.min("seq")).first()[0] == 500
    exported = {r.name: r for r in metrics.export_metrics(df).collect()}
    assert [p.value for p in exported["g"].points] == [float(i) for i in range(1400, 1500)]
    assert exported["c"].current_value == 9.0
    values = [rng.choice([0.005, 0.3, 1.0, rng.random() * 20]) for _ in range(500)]
    hist = metrics.histogram(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()
    assert {r.le: r.cumulative_count for r in hist} == {r.le: sum(v <= r.le for v in values) for r in hist}
    assert max(r.le for r in hist) == math.inf


def test_percentiles_are_exact(spark):
    rng = random.Random(5)
    groups = {
        "even": [float(i) for i in range(1000)], "one": [3.5], "same": [2.0] * 50,
        "skew": [rng.expovariate(1) ** 6 for _ in range(700)], "hot": [1.0] * 900 + [rng.random() for _ in range(100)],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("even", None)], "g string, v double")
    wanted = [0.0, 0.01, 0.5, 0.9, 0.99, 1.0]
    got = {(r.g, r.quantile): r.value for r in metrics.percentiles(df, "v", ["g"], wanted, small=40).collect()}
    expected = {(g, q): sorted(vs)[max(math.ceil(q * len(vs)), 1) - 1] for g, vs in groups.items() for q in wanted}
    assert got == expected


def test_summary_of_nothing(spark):
    log = spark.createDataFrame([], "ts timestamp, outcome string, response_time double, bytes bigint")
    row = metrics.crawl_summary(log).first()
    assert row.urls_crawled == 0 and row.pages_per_minute == 0.0


def test_logs(spark, tmp_path):
    lines = [
        {"timestamp": "2024-01-01T00:00:01.5Z", "level": "INFO", "logger": "a", "message": "m", "event_type": "url_event"},
        {"level": "DEBUG", "logger": "a", "message": "Resetting dropped connection: x"},
        {"level": "INFO", "logger": "a", "message": "connection pool"},
        {"level": "ERROR", "logger": "urllib3.connectionpool.x", "message": "m", "exception": "E"},
        {"level": "INFO", "logger": None, "message": None, "event_type": "crawler_stat", "stat_value": 2},
    ]
    (tmp_path / "a.json").write_text("\n".join(json.dumps(x) for x in lines) + "\nbroken {\n")
    logs = read_logs(spark, str(tmp_path))
    assert logs.count() == 5
    assert sorted((r.level, r.message) for r in without_noise(logs).filter("message is not null").collect()) == [
        ("INFO", "connection pool"), ("INFO", "m"),
    ]
    assert without_noise(logs).count() == 3
    assert {tuple(r) for r in events_by_kind(logs).collect()} == {("url_event", "INFO", 1), ("crawler_stat", "INFO", 1)}
    write_json(logs.select("level", "exception"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).columns == ["exception", "level"]


def _write_batches(df, path, parts):
    rows = df.orderBy("id").collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        part = rows[i * size:(i + 1) * size]
        df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)


def test_stream_dedup_equals_batch(spark, small, tmp_path):
    """Any number of micro-batches keeps what one pass keeps."""
    documents = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    documents = documents.withColumn("url", F.concat(F.lit("http://h/"), F.col("id") % 190)).select("id", "url", "content")
    expected = {r.id for r in D.greedy_dedup(D.with_keys(documents), "id").filter("kept").collect()}
    source = str(tmp_path / "in")
    _write_batches(documents, source, 3)
    stream = ingest.stream_pages(spark, source, schema=documents.schema, max_files_per_trigger=1)
    pages, keys = str(tmp_path / "pages"), str(tmp_path / "keys")
    ingest.dedup_stream(stream, pages, keys, str(tmp_path / "state"), "id", "id").awaitTermination()
    assert {r.id for r in spark.read.parquet(pages).collect()} == expected
    assert spark.read.parquet(pages).select("batch_id").distinct().count() == 3
    # The same batches again, from the start: nothing changes.
    again = ingest.stream_pages(spark, source, schema=documents.schema, max_files_per_trigger=1)
    ingest.dedup_stream(again, pages, keys, str(tmp_path / "state2"), "id", "id").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(pages).collect()) == sorted(expected)


def test_runs_with_their_own_checkpoints_keep_each_other(spark, tmp_path):
    """A second run on the same tables loses nothing of the first and finds duplicates of it."""
    pages, keys = str(tmp_path / "pages"), str(tmp_path / "keys")
    inputs = ([(1, "http://h/a", "one text")], [(2, "http://h/b", "other words"), (3, "http://h/a", "changed")])
    for k, rows in enumerate(inputs):
        df = spark.createDataFrame(rows, "id long, url string, content string")
        df.write.parquet(str(tmp_path / f"in{k}"))
        stream = ingest.stream_pages(spark, str(tmp_path / f"in{k}"), schema=df.schema)
        ingest.dedup_stream(stream, pages, keys, str(tmp_path / f"state{k}"), "id", "id").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(pages).collect()) == [1, 2]


def test_gauges_take_every_number_and_percentiles_no_key(spark):
    one = spark.sql("SELECT 1S AS a, 2Y AS b, CAST(3.5 AS DECIMAL(5, 2)) AS c, 'x' AS d, 4L AS e")
    assert {r.name: r.value for r in metrics.as_gauges(one, "").collect()} == {"a": 1.0, "b": 2.0, "c": 3.5, "e": 4.0}
    values = spark.range(1, 101).select(F.col("id").cast("double").alias("v"))
    assert [tuple(r) for r in metrics.percentiles(values, "v", [], [0.5]).collect()] == [(0.5, 50.0)]


def test_stream_extraction_equals_batch(spark, small, tmp_path):
    out = str(tmp_path / "out")
    stream = ingest.stream_pages(spark, small, schema=PAGES, pattern="pages.parquet")
    ingest.extract_stream(stream, out, str(tmp_path / "state")).awaitTermination()
    batch = extract_pages(spark.read.parquet(f"{small}/pages.parquet"))
    key = lambda df: sorted(str(r) for r in df.select("page_id", "title", "content", "links").collect())
    assert key(spark.read.parquet(out)) == key(batch)


def test_times_do_not_depend_on_the_session_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:00' AS t")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = df.select(
            F.unix_micros(ingest.as_instant(F.col("t"))).alias("m"), ingest.without_zone(ingest.as_instant(F.col("t"))).alias("b")
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert row.m == 1710037800000000 and row.b == datetime.datetime(2024, 3, 10, 2, 30)


def test_streamed_progress_equals_batch(spark, tmp_path, monkeypatch):
    """Three batches, with records that come late, give the totals of one pass; spans are summed apart."""
    monkeypatch.setattr(ingest, "_SPAN_WINDOWS", 4)
    rng = random.Random(6)
    rows = [(DAY + datetime.timedelta(seconds=rng.randrange(900)), rng.choice(["stored", "error", "duplicate"]), rng.random(), rng.randrange(4)) for _ in range(300)]
    rows.sort(key=lambda r: r[0] + datetime.timedelta(seconds=rng.randrange(60)))
    schema = "ts timestamp, outcome string, response_time double, added long"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        spark.createDataFrame(rows[k * 100:(k + 1) * 100], schema).coalesce(1).write.mode("append").parquet(source)
    stream = ingest.stream_pages(spark, source, schema=spark.createDataFrame([], schema).schema, max_files_per_trigger=1)
    ingest.progress_stream(stream, out, str(tmp_path / "state"), 30, "10 minutes").awaitTermination()
    key = lambda df: sorted((r.window_start, r.total_crawled, r.total_errors, r.queue_size, round(r.average_time_so_far, 9), round(r.average_pages_per_minute, 9)) for r in df.collect())
    streamed = key(ingest.read_progress(spark, out, 30, queued=50))
    assert streamed == key(ingest.with_totals(ingest.progress(spark.createDataFrame(rows, schema)), 30, 50))
    assert streamed[-1][1] == 300 and streamed[-1][3] == 50 + sum(r[3] for r in rows) - 300
    assert len(spark.read.parquet(out).select("batch_id").distinct().collect()) >= 3
    so_far = [r for r in rows if r[0] < streamed[7][0] + datetime.timedelta(seconds=30)]
    assert streamed[7][1:3] == (len(so_far), sum(r[1] == "error" for r in so_far))


def test_a_table_streams_as_one_file_and_as_a_folder(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"http://h/{i}", "<title>t</title>") for i in range(9)], PAGES)
    rows.repartition(3).write.parquet(str(tmp_path / "folder/pages.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "file/pages.parquet")
    for kind in ("folder", "file"):
        got = metric_queries.stream_ingest(spark, str(tmp_path / kind))
        assert sorted((r.page_id, r.title) for r in got.collect()) == [(i, "t") for i in range(9)]


def test_streamed_batches_arrive_as_many_files(spark, tmp_path, monkeypatch):
    """One file for a batch is read, and its pages are extracted, by one task."""
    monkeypatch.setattr(metric_queries, "work_folder", lambda spark, name: str(tmp_path / name))
    rows = [(i, f"http://h/{i}", f"<article>{'same words' if i % 4 == 0 else f'alpha{i}alpha beta{i}beta'}</article>") for i in range(240)]
    spark.createDataFrame(rows, PAGES).coalesce(1).write.parquet(str(tmp_path / "in/pages.parquet"))
    kept = {r.id for r in metric_queries.stream_dedup(spark, str(tmp_path / "in")).collect()}
    records = extract_pages(spark.createDataFrame(rows, PAGES)).withColumnRenamed("page_id", "id")
    assert kept == {r.id for r in D.greedy_dedup(D.with_keys(records), "id").filter("kept").collect()}
    assert len(list((tmp_path / "page-files").glob("*.parquet"))) >= 3 * min(spark.sparkContext.defaultParallelism, 4)
    assert spark.read.parquet(str(tmp_path / "kept-pages")).select("batch_id").distinct().count() == 3
