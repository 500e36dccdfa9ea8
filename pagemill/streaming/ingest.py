"""Streaming: page ingest, duplicate detection, progress, and state between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pagemill.functions.values import HASH_RETENTION_DAYS, PRIORITY_HIGH, REPORT_SECONDS
from pagemill.operators.dedup import DEFAULT, KEY_TYPES, greedy_dedup, key_rows, with_keys
from pagemill.operators.extract import extract_pages
from pagemill.operators.frontier import tasks
from pagemill.schemas import PAGES
from pagemill.session import written
from pagemill.sources import keylevels

_ONCE = {"availableNow": True}


def stream_pages(
    spark: SparkSession, path: str, format: str = "parquet", schema: StructType = PAGES,
    max_files_per_trigger: int | None = None, pattern: str | None = None,
) -> DataFrame:
    """A folder of page files as a stream."""
    reader = spark.readStream.format(format).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def table_path(folder: str, name: str) -> str:
    """What to hand to :func:`stream_pages` for a Parquet table of ``folder``, whether one file or a folder of files.

    A stream takes a single file only under a pattern, and a filter by name would leave out the files of a folder.
    """
    return f"{folder}/{name}.parque[t]"


def extract_stream(
    pages: DataFrame, path: str, checkpoint: str, mode: str = "auto", trigger: dict | None = None, **rules
) -> StreamingQuery:
    """Extract every arriving page and append the records to ``path``.  Stateless, exactly once.

    ``trigger`` is as for ``writeStream.trigger``, as in ``{"processingTime": "1 minute"}``;
    by default the stream takes what is there and ends.
    """
    return (
        extract_pages(pages, mode, **rules).writeStream.format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or _ONCE)).start()
    )


def dedup_stream(
    records: DataFrame,
    pages_path: str,
    keys_path: str,
    checkpoint: str,
    order: str,
    id: str,
    now: Column | None = None,
    retention_days: int | None = None,
    trigger: dict | None = None,
    fan_in: int = keylevels.FAN_IN,
) -> StreamingQuery:
    """Keep-first over several keys, across batches.

    No single key partitions this state, so each batch is checked against a
    table of stored keys (``sources.keylevels``), deduplicated in itself, and
    written with its keys under its run and batch number: a batch that runs
    again overwrites its own output and changes nothing.  The run is the
    query's id, which lives in the checkpoint: a new checkpoint is a new run,
    which sees the keys of all earlier runs and never overwrites their output.
    One run at a time may write to a pair of tables.  Pages are written before
    keys, and keys of later batches are never read, so a lost driver cannot
    leave a batch half seen.  Segments of keys are merged before a batch, by
    ``fan_in`` of a level; with ``retention_days`` older keys stay behind.
    """
    first_seen = F.current_timestamp() if now is None else now

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if run is None:
            raise RuntimeError("the streaming query's id is not known")
        place = f"run={run}/batch_id={batch_id}"
        recent = None if retention_days is None else F.col("first_seen") >= first_seen - F.make_dt_interval(F.lit(retention_days))
        keylevels.settle(spark, keys_path, run, batch_id, fan_in, recent)
        # Records are computed once, with their keys.  Ids and keys go through the steps; the records are joined to what is kept.
        columns = list(dict.fromkeys([id, order, *(f"{t}_key" for t in KEY_TYPES)]))
        arrived = written(with_keys(batch), "batch-records")
        keyed = arrived.select(columns)
        seen = keylevels.stored_among(spark, keys_path, key_rows(keyed, DEFAULT, carry=()).distinct(), run, batch_id)
        marked = greedy_dedup(keyed, order, DEFAULT, id, seen if recent is None else seen.filter(recent))
        kept = written(marked.filter("kept").select(id, *(f"{t}_key" for t in KEY_TYPES)), "batch-kept")
        arrived.select(batch.columns).join(kept, id).write.mode("overwrite").parquet(f"{pages_path}/{place}")
        keylevels.append_keys(spark, keys_path, key_rows(kept, DEFAULT, carry=()).distinct(), first_seen, run, batch_id)

    return (
        records.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or _ONCE)).start()
    )


def dedup_one_key(records: DataFrame, key: str, ts: str, days: int = HASH_RETENTION_DAYS) -> DataFrame:
    """Keep one record per key within the retention time; older keys leave the state."""
    return records.withWatermark(ts, f"{days} days").dropDuplicatesWithinWatermark([key])


_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def as_instant(ts: Column) -> Column:
    """A time without zone, read as UTC whatever the session's zone."""
    since = ts - F.expr(_EPOCH)
    minutes = (F.extract(F.lit("DAY"), since) * 24 + F.extract(F.lit("HOUR"), since)) * 60 + F.extract(F.lit("MINUTE"), since)
    return F.timestamp_micros(
        minutes.cast("bigint") * 60_000_000 + (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("bigint")
    )


def without_zone(ts: Column) -> Column:
    """The reverse of :func:`as_instant`."""
    seconds = (F.unix_micros(ts).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.expr(_EPOCH) + F.make_dt_interval(secs=seconds)


_COUNTS = ("crawled", "stored", "errors", "duplicates")
# Windows whose totals are summed up together, before the sums of such spans.
_SPAN_WINDOWS = 4096


def progress(log: DataFrame, seconds: int = REPORT_SECONDS, watermark: str | None = None) -> DataFrame:
    """Crawl progress per tumbling window; batch and stream alike.

    ``log`` has ``ts``, ``outcome`` and ``response_time``, and may have
    ``added``, the URLs that a record put into the queue.
    """
    source = log.withWatermark("ts", watermark) if watermark else log
    added = F.coalesce(F.sum("added"), F.lit(0)) if "added" in log.columns else F.lit(0)
    return source.groupBy(F.window("ts", f"{seconds} seconds")).agg(
        F.count(F.lit(1)).alias("crawled"),
        F.count_if(F.col("outcome") == "stored").alias("stored"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicates"),
        F.avg("response_time").alias("average_response_time"),
        added.cast("bigint").alias("added"),
    ).select(
        F.col("window.start").alias("window_start"), *_COUNTS,
        (F.col("crawled") * 60.0 / seconds).alias("pages_per_minute"), "average_response_time", "added",
    )


def with_totals(windows: DataFrame, seconds: int = REPORT_SECONDS, queued: int = 0) -> DataFrame:
    """Windows of :func:`progress` with what holds at their end: totals so far, their rate and mean, and the queue size.

    ``queued`` URLs were in the queue at the start; each crawled one leaves it.
    Sums run over spans of windows first and then inside of them, so a long
    crawl is not summed up in one task.
    """
    span = F.floor(F.unix_seconds("window_start") / (seconds * _SPAN_WINDOWS))
    parts = {**{c: F.col(c) for c in (*_COUNTS, "added")}, "spent": F.coalesce(F.col("average_response_time"), F.lit(0.0)) * F.col("crawled")}
    cut = windows.withColumn("_span", span)
    earlier = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = cut.groupBy("_span").agg(F.min("window_start").alias("_from"), *(F.sum(v).alias(f"_{n}") for n, v in parts.items())).select(
        "_span", F.min("_from").over(Window.orderBy("_span")).alias("_start"),
        *(F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in parts),
    )
    inside = Window.partitionBy("_span").orderBy("window_start")
    totals = {n: (F.col(f"_{n}") + F.sum(v).over(inside)) for n, v in parts.items()}
    summed = cut.join(spans, "_span").select(
        *windows.columns, F.least("_start", F.min("window_start").over(inside)).alias("_start"), *(v.alias(f"total_{n}") for n, v in totals.items())
    )
    minutes = (F.unix_seconds("window_start") - F.unix_seconds("_start") + seconds) / 60
    return summed.select(
        *windows.columns, *(f"total_{c}" for c in _COUNTS), (F.col("total_crawled") / minutes).alias("average_pages_per_minute"),
        (F.col("total_spent") / F.col("total_crawled")).alias("average_time_so_far"),
        (F.lit(queued) + F.col("total_added") - F.col("total_crawled")).cast("bigint").alias("queue_size"),
    )


def progress_stream(
    log: DataFrame, path: str, checkpoint: str, seconds: int = REPORT_SECONDS, watermark: str = "10 minutes", trigger: dict | None = None
) -> StreamingQuery:
    """Write each batch's changed windows under its number; :func:`read_progress` gives the report so far."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        progress(log, seconds, watermark).writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or _ONCE)).start()
    )


def read_progress(spark: SparkSession, path: str, seconds: int = REPORT_SECONDS, queued: int = 0) -> DataFrame:
    """The report: every window as last written, with totals.  Late records change the totals of all later windows."""
    written_rows = spark.read.parquet(path)
    columns = [c for c in written_rows.columns if c not in ("batch_id", "window_start")]
    latest = written_rows.groupBy("window_start").agg(F.max_by(F.struct(*columns), "batch_id").alias("w")).select("window_start", "w.*")
    return with_totals(latest, seconds, queued)


# --- state between runs ----------------------------------------------------


def save_frontier(frontier: DataFrame, path: str, run: int) -> None:
    """Write the whole frontier as it stands after ``run``: a snapshot, from which later loads start."""
    frontier.write.mode("overwrite").parquet(f"{path}/snapshots/run={run}")


def log_frontier(path: str, run: int, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
    """Append what ``run`` put into the frontier and what it took out (``url``); running it again replaces both.

    A URL that a run both took out and put in, as a retry does, is in.
    """
    for kind, rows in (("added", added), ("removed", None if removed is None else removed.select("url").distinct())):
        if rows is not None:
            rows.write.mode("overwrite").parquet(f"{path}/changes/{kind}/run={run}")


def _runs(spark: SparkSession, folder: str) -> list[int]:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    return sorted(int(n.removeprefix("run=")) for n in names if n.startswith("run="))


def load_frontier(spark: SparkSession, path: str, run: int, schema: StructType) -> DataFrame:
    """The frontier as left by ``run``: the last snapshot and the changes since; empty if there is neither.

    The last change of a URL counts.
    """
    snapshots = [r for r in _runs(spark, f"{path}/snapshots") if r <= run]
    start = snapshots[-1] if snapshots else -1
    parts = [spark.read.schema(schema).parquet(f"{path}/snapshots/run={start}").withColumns({"_run": F.lit(start), "_in": F.lit(True)})] if snapshots else []
    for kind, present in (("added", True), ("removed", False)):
        own = schema if present else StructType([schema["url"]])
        for changed in _runs(spark, f"{path}/changes/{kind}"):
            if start < changed <= run:
                rows = spark.read.schema(own).parquet(f"{path}/changes/{kind}/run={changed}")
                parts.append(rows.withColumns({"_run": F.lit(changed), "_in": F.lit(present)}))
    if not parts:
        return spark.createDataFrame([], schema)
    if len(parts) == 1 and snapshots:
        return parts[0].select(schema.names)
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    last = F.max_by(F.struct("_in", *(c for c in schema.names if c != "url")), F.struct("_run", "_in"))
    return rows.groupBy("url").agg(last.alias("r")).filter("r._in").select(*(F.col("url") if c == "url" else F.col(f"r.{c}") for c in schema.names))


def snapshot_frontier(spark: SparkSession, path: str, run: int, schema: StructType) -> None:
    """Make the frontier after ``run`` a snapshot, so that loads need no older changes.  Do it every few runs."""
    save_frontier(load_frontier(spark, path, run, schema), path, run)


def recrawl_due(crawls: DataFrame, now: Column, interval_seconds: int) -> DataFrame:
    """Frontier rows for URLs whose last crawl lies ``interval_seconds`` or more back."""
    last = crawls.groupBy("url").agg(F.max("ts").alias("last_crawl"))
    age = F.unix_micros(now) - F.unix_micros("last_crawl")
    return tasks(last.filter(age >= interval_seconds * 1_000_000), 0, PRIORITY_HIGH)
