"""Session helpers: recommended settings and the shared work folder."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

# What we ask of a session we create ourselves.  A session handed in by the
# caller is used as it is; nothing here is set on it.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "pagemill") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a session on one machine may be without that setting.  It gets a
    temporary folder, once, as its checkpoint folder; on a cluster a
    machine-local folder would lose data with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pagemill-"))
    return context.getCheckpointDir()


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables, below the shared folder."""
    return f"{_shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and read it back.

    The data survives the loss of executors, and each loop round starts from
    a plain scan instead of an ever longer plan.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_shared_root(spark))
    return df.checkpoint(eager=True)


def placed_by(df: DataFrame, key: str, name: str = "placed") -> DataFrame:
    """Write ``df`` bucketed by ``key`` in the shared folder and read it back.

    Joins on ``key`` then leave it where it is, and each reads only the
    columns it needs: for a table that a loop joins again and again.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"pagemill_{uuid.uuid4().hex}"
    (
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
        .option("path", work_folder(spark, name)).saveAsTable(table)
    )
    return spark.table(table)


def written(df: DataFrame, name: str) -> DataFrame:
    """Like :func:`cut_lineage`, as Parquet: keeps column pruning and filter pushdown."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def built_once(function):
    """Keep the Columns a function builds, per JVM: large expressions take seconds to assemble.

    Arguments must be hashable (names and settings, not Columns).
    """
    built = {}

    @functools.wraps(function)
    def wrapper(*args):
        key = (id(SparkContext._gateway), *args)
        if key not in built:
            built[key] = function(*args)
        return built[key]

    return wrapper
