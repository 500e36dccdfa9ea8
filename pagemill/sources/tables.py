"""Reading pages, seeds and logs; writing JSON."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagemill.functions.values import NOISY_DEBUG_PHRASES, NOISY_LOGGERS
from pagemill.schemas import LOG_RECORDS, PAGES


def read_pages(spark: SparkSession, path: str, format: str = "parquet", schema: StructType = PAGES) -> DataFrame:
    """Stored pages; the schema is given, so nothing is scanned to infer it."""
    return spark.read.format(format).schema(schema).load(path)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """A table scan over at least as many tasks as there are cores.

    For work that is heavy per row on a table of few files.  Large tables have
    more splits than that and are left as they are, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, *keys)


def seed_urls(spark: SparkSession, urls: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(u,) for u in urls], "url string")


def read_logs(spark: SparkSession, path: str, schema: StructType = LOG_RECORDS) -> DataFrame:
    """Structured log lines.  Lines that are not JSON become rows of nulls and are dropped."""
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return rows.filter(F.col("level").isNotNull()).withColumn("ts", F.try_to_timestamp("timestamp"))


def without_noise(logs: DataFrame) -> DataFrame:
    """Drop records of noisy loggers and two frequent debug messages."""
    noisy = F.lit(False)
    for prefix in NOISY_LOGGERS:
        noisy = noisy | F.startswith("logger", F.lit(prefix))
    message = F.lower("message")
    phrase = F.lit(False)
    for text in NOISY_DEBUG_PHRASES:
        phrase = phrase | F.contains(message, F.lit(text))
    return logs.filter(~F.coalesce(noisy | ((F.col("level") == "DEBUG") & phrase), F.lit(False)))


def events_by_kind(logs: DataFrame) -> DataFrame:
    """Count of log events per kind and level."""
    return (
        logs.filter(F.col("event_type").isNotNull())
        .groupBy("event_type", "level").agg(F.count(F.lit(1)).alias("records"))
    )


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per row; nulls are kept so that every record has all fields."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
