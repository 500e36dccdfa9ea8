"""Random shards of equal row counts by a two-pass external shuffle.

Pass one scatters the records uniformly over buckets that fit in a task's
memory, by a seeded hash.  Pass two puts each bucket into random order with
Spark's ``shuffle`` (a Fisher-Yates shuffle).  Bucket after bucket, the places
then form one random permutation of the table, which is dealt over the shards.

Every step can be repeated with the same outcome, which a lost executor
demands: the scatter depends on the record alone; a bucket is sorted before it
is shuffled; and the generator, which Spark seeds for each partition, meets
the buckets of its partition in sorted order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm.common import text_of, total

# Buckets whose sizes are summed up together: the prefix sums need two steps of about this many rows.
_RUN = 1024


def external_shuffle(
    df: DataFrame, shards: int = 16, seed: int = 20, bucket_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """All columns of ``df`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard).

    The counts of any two shards differ by one at most.  ``bucket_bytes`` is
    what a bucket holds on average, counted as UTF-8 bytes of text; a text
    larger than that has a bucket that is larger.  Null ids and texts are
    scattered like others; rows that agree in id and text meet in one bucket,
    each with its own slot.  Columns named ``shard`` or ``slot`` are replaced.
    Columns must have an order, so maps are not supported.
    """
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    size = F.octet_length(text_of(text_col)) + 1
    buckets = max(1, -(-total(df, size) // bucket_bytes))
    mixed = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    records = df.select(
        F.pmod(mixed, F.lit(buckets)).cast("int").alias("bucket"), mixed.alias("mixed"),
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("record"),
    )
    ordered = records.repartition(buckets, "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("mixed", "record"))).alias("held"))
    mixed_up = ordered.sortWithinPartitions("bucket").select("bucket", F.shuffle("held", seed).alias("held"))
    placed = mixed_up.select("bucket", F.posexplode("held").alias("place", "row"))
    position = F.col("before") + F.col("place")
    return placed.join(_before(records), "bucket").select(
        "row.record.*", F.pmod(position, F.lit(shards)).cast("int").alias("shard"), F.floor(position / shards).alias("slot"),
    )


def _before(records: DataFrame) -> DataFrame:
    """For each bucket the number of rows in all buckets before it, by prefix sums in two steps."""
    counts = records.groupBy("bucket").count().withColumn("run", F.floor(F.col("bucket") / _RUN))
    up_to = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy("run").agg(F.sum("count").alias("rows")).select("run", F.coalesce(F.sum("rows").over(up_to), F.lit(0)).alias("base"))
    inside = Window.partitionBy("run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.join(runs, "run").select("bucket", (F.col("base") + F.coalesce(F.sum("count").over(inside), F.lit(0))).alias("before"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write shuffled records below ``shard=N`` folders, in the order of their slots."""
    shuffled.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digest(shuffled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each record: its size (UTF-8 bytes plus 1), checksum, shard and slot."""
    text = text_of(text_col)
    return shuffled.select(
        id_col, (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
