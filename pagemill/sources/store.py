"""The content table: keyed by URL hash, partitioned by its first two digits.

Storing appends.  Replacing partitions instead would rewrite the whole table,
since any batch of more than a few hundred URLs touches all 256 prefixes.
Readers take the newest row of a key; ``compact`` makes that permanent.

The files are the key index.  The hash is spread evenly, so ranges of it are
known without a look at the data: each write task gets one range, and its
files hold it in order.  Bounds of row groups and pages, and Bloom filters of
the keys, then let a scan for one key read one small row group of one file per
write, and nothing of the others but their footers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions.urls import storage_hash
from pagemill.functions.values import STORAGE_VERSION
from pagemill.schemas import CONTENT

PREFIX_LENGTH = 2
# Small row groups: a lookup reads one for each file that may hold its key.
ROW_GROUP_BYTES = 8 << 20
# Files of a compacted table per task that writes it; more files, more even tasks.
_PIECES = 8
_STORAGE = ("url_hash", "hash_prefix", "stored_at", "storage_version", "write_seq", "row_hash")


def content_rows(records: DataFrame, stored_at: Column, write_seq: int = 0) -> DataFrame:
    """Records with key, prefix and storage columns; ``row_hash`` covers all of a record."""
    structured = F.to_json(F.transform_values("schema_org_data", lambda _, objects: objects))
    rows = records.withColumn("schema_org_data", F.when(F.size("schema_org_data") > 0, structured))
    record = [f.name for f in CONTENT if f.name not in _STORAGE]
    rows = rows.withColumns({
        "url_hash": storage_hash(F.col("url")),
        "stored_at": stored_at,
        "storage_version": F.lit(STORAGE_VERSION),
        "write_seq": F.lit(write_seq),
        "row_hash": F.xxhash64(F.to_json(F.struct(*record))),
    }).withColumn("hash_prefix", F.substring("url_hash", 1, PREFIX_LENGTH))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CONTENT])


def _write_tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _range_of_key(ranges: int) -> Column:
    """Which of ``ranges`` equal ranges of the hash a key lies in."""
    digits = 12
    return F.floor(F.conv(F.substring("url_hash", 1, digits), 16, 10).cast("bigint") / F.lit(float(16**digits)) * ranges).cast("int")


def _written_to(rows: DataFrame, path: str, mode: str, row_group_bytes: int) -> None:
    (
        rows.write.mode(mode).partitionBy("hash_prefix")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.enable.dictionary#url_hash", "false")  # every key differs; a dictionary would take the filter's place
        .option("parquet.bloom.filter.enabled#url_hash", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .parquet(path)
    )


def _claimed_sequence(spark: SparkSession, path: str) -> int:
    """The number of a write, one more than any before; claimed by a file, below a name that readers skip."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{path}/_writes")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    while True:
        taken = sorted(int(s.getPath().getName()) for s in files.listStatus(folder))
        number = taken[-1] + 1 if taken else 1
        if files.createNewFile(hadoop.Path(folder, str(number))):
            for older in taken:
                files.delete(hadoop.Path(folder, str(older)), False)
            return number


def store_content(
    records: DataFrame, path: str, stored_at: Column | None = None, tasks: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES,
) -> None:
    """Append records, in ``tasks`` ranges of the key (by default as many as shuffle partitions).

    Each write has a number, so of rows stored at the same instant the one
    written last counts.  Of rows of one write and instant that differ, the
    one with the larger hash over the whole record does.
    """
    spark = records.sparkSession
    tasks = tasks or _write_tasks(spark)
    rows = content_rows(records, F.current_timestamp() if stored_at is None else stored_at, _claimed_sequence(spark, path))
    placed = rows.repartitionById(tasks, _range_of_key(tasks)).sortWithinPartitions("hash_prefix", "url_hash")
    _written_to(placed, path, "append", row_group_bytes)


def _newest(rows: DataFrame, *placed: str) -> DataFrame:
    # Spark trims every task to one row per key before the shuffle (window
    # group limit), so a URL stored very often does not pile up anywhere.  No
    # text is read that is not asked for.
    latest = Window.partitionBy(*placed, "url_hash").orderBy(F.desc("stored_at"), F.desc("write_seq"), F.desc("row_hash"))
    return rows.withColumn("_rn", F.row_number().over(latest)).filter("_rn = 1").drop("_rn")


def _scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONTENT).parquet(path)


def read_content(spark: SparkSession, path: str) -> DataFrame:
    """The table as last written: one row per URL."""
    return _newest(_scan(spark, path))


def _rows_of(spark: SparkSession, path: str, url: str) -> DataFrame:
    key = F.sha2(F.lit(url), 256)
    return _scan(spark, path).filter((F.col("hash_prefix") == F.substring(key, 1, PREFIX_LENGTH)) & (F.col("url_hash") == key))


def get_content(spark: SparkSession, path: str, url: str) -> DataFrame:
    """One record by URL: reads one partition, with the key pushed to the scan."""
    return as_records(_newest(_rows_of(spark, path, url)))


def _keys_of(urls: DataFrame) -> DataFrame:
    return urls.select(storage_hash(F.col("url")).alias("url_hash")).distinct().withColumn("hash_prefix", F.substring("url_hash", 1, PREFIX_LENGTH))


def get_contents(spark: SparkSession, path: str, urls: DataFrame) -> DataFrame:
    """Records of many URLs.  Spark broadcasts the keys if they turn out small."""
    rows = _scan(spark, path).join(_keys_of(urls), ["hash_prefix", "url_hash"], "left_semi")
    return as_records(_newest(rows))


def content_exists(spark: SparkSession, path: str, urls: DataFrame) -> DataFrame:
    """``urls`` with ``stored``: reads the key columns only, and keeps of them what was asked for before anything is made distinct."""
    stored = _scan(spark, path).select("hash_prefix", "url_hash").join(_keys_of(urls), ["hash_prefix", "url_hash"], "left_semi")
    found = stored.select(F.col("url_hash").alias("_key")).distinct().withColumn("_found", F.lit(True))
    asked = urls.withColumn("_key", storage_hash(F.col("url")))
    return asked.join(found, "_key", "left").select(*urls.columns, F.coalesce("_found", F.lit(False)).alias("stored"))


def as_records(rows: DataFrame) -> DataFrame:
    """Without key and storage columns; structured data parsed back."""
    return rows.drop(*_STORAGE).withColumn(
        "schema_org_data",
        F.coalesce(
            F.from_json("schema_org_data", "map<string,array<string>>"),
            F.create_map().cast("map<string,array<string>>"),
        ),
    )


def url_index(spark: SparkSession, path: str) -> DataFrame:
    """URL to hash, time and status: a projection, not a second table."""
    return _scan(spark, path).groupBy("url", "url_hash").agg(F.max("stored_at").alias("indexed_at")).withColumn("status", F.lit("stored"))


def storage_stats(spark: SparkSession, path: str) -> DataFrame:
    """Stored rows, stored URLs, rows without content, and the size of the stored records as JSON in UTF-8."""
    rows = _scan(spark, path)
    record = F.struct(*[c for c in rows.columns if c not in _STORAGE])
    return rows.agg(
        F.count(F.lit(1)).alias("total_stored"),
        F.count_distinct("url_hash").alias("total_urls"),
        F.count_if(F.coalesce("content", F.lit("")) == "").alias("without_content"),
        F.coalesce(F.sum(F.octet_length(F.to_json(record))), F.lit(0)).cast("bigint").alias("total_size_bytes"),
    )


def _compacted(rows: DataFrame, tasks: int) -> DataFrame:
    """The newest rows, in order and in the tasks that write them: one shuffle serves both."""
    placed = rows.withColumn("_range", _range_of_key(tasks * _PIECES)).repartition(tasks, "_range")
    return _newest(placed, "hash_prefix", "_range").drop("_range")


def compact(spark: SparkSession, path: str, target: str, tasks: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Write the newest rows of all keys to a new folder.  Later writes to it are numbered after those of the old one."""
    _written_to(_compacted(_scan(spark, path), tasks or _write_tasks(spark)), target, "errorifexists", row_group_bytes)
    hadoop = spark._jvm.org.apache.hadoop.fs
    old, new = hadoop.Path(f"{path}/_writes"), hadoop.Path(f"{target}/_writes")
    files = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(old):
        last = max((int(s.getPath().getName()) for s in files.listStatus(old)), default=0)
        target_files = new.getFileSystem(spark._jsc.hadoopConfiguration())
        target_files.mkdirs(new)
        target_files.createNewFile(hadoop.Path(new, str(last)))
