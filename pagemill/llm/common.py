"""Small helpers that the operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.session import written

# One step in a Python worker handles about so many bytes of text at a time.
BLOCK_BYTES = 4 << 20


def text_of(name: str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about ``limit`` bytes of ``column``, and one row at least."""
    for batch in batches:
        sizes = batch.column(column).cast(pa.large_string()).cast(pa.large_binary())
        start = held = 0
        for row, value in enumerate(sizes):
            size = value.as_buffer().size if value.is_valid else 0
            if held and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)


_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, limit: int = 2 << 20) -> Iterator[None]:
    """What runs within hands rows to Python workers in Arrow batches of about ``limit`` bytes.

    By default a batch has up to 10,000 rows, tens of MB of text, which an
    executor holds several times outside its heap, as does its worker.  A limit
    that the session has set itself stands; otherwise none is set afterwards.
    Results do not depend on it.
    """
    if spark.conf.get(_BATCH_LIMIT, None) is not None:
        yield
        return
    spark.conf.set(_BATCH_LIMIT, str(limit))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_LIMIT)


# What empties the caches that operators keep in this Python worker from task to task.
_kept_by: dict[str, Callable[[], None]] = {}


def takes_over(operator: str, free: Callable[[], None] | None = None) -> None:
    """A task of ``operator`` begins: a worker that goes on from another operator's tasks gives up what that one kept.

    ``free`` empties what this one keeps, once it has to go as well.
    """
    others = [o for o in _kept_by if o != operator]
    for other in others:
        _kept_by.pop(other)()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
    if free is not None:
        _kept_by[operator] = free


def total(df: DataFrame, column: Column) -> int:
    """One number over the whole table; 0 where it is empty."""
    return int(df.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0])


# A list of keys may be broadcast up to this size; beyond it the rows are shuffled instead.
BROADCAST_BYTES = 8 << 20


def _joined(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    own = "_key"
    while own.lower() in {c.lower() for c in rows.columns}:
        own = f"_{own}"
    keys = keys.select(F.col(key).alias(own)).distinct()
    width = 16 + total(keys.limit(1000), F.octet_length(F.col(own).cast("string"))) // 1000
    if keys.count() * width <= BROADCAST_BYTES:
        keys = F.broadcast(keys)
    return rows.join(keys, F.col(key).eqNullSafe(F.col(own)), how)


def semi_join(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``keys`` (null equals null).  Broadcasts the keys only where their counted size is small."""
    return _joined(rows, keys, key, "left_semi")


def anti_join(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``keys`` (null equals null), in the same way."""
    return _joined(rows, keys, key, "left_anti")


# Bits of a Bloom filter for each key, and how many of them a key sets; bits of one of Spark's bitmaps, and the most
# bitmaps of a filter: 64 MB, whatever the number of keys.  Beyond that more rows pass that need not.
_KEY_BITS, _HASHES, _BITMAP_BITS, MOST_BITMAPS = 16, 5, 32768, 16384


def _bits(key: str) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), key), F.lit(_BITMAP_BITS)).cast("int") for i in range(_HASHES)]


def filtered(rows: DataFrame, keys: DataFrame, key: str, most: int = MOST_BITMAPS) -> DataFrame:
    """Rows whose key may be among ``keys`` (distinct, not null): all that are, and few that are not.

    The filter is broadcast; its size has a bound, so this is one way for any
    number of keys.
    """
    count = max(1, keys.count())
    bitmaps = min(most, -(-count * _KEY_BITS // _BITMAP_BITS))
    place = F.pmod(F.xxhash64(key), F.lit(bitmaps)).cast("int").alias("_map")
    made = keys.select(place, F.explode(F.array(*_bits(key))).alias("_bit")).groupBy("_map").agg(F.bitmap_construct_agg(F.col("_bit").cast("bigint")).alias("_set"))

    def present(bit: Column) -> Column:
        octet = F.conv(F.hex(F.substr(F.col("_set"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(octet, bit % 8) == 1

    met = rows.withColumn("_map", place).join(F.broadcast(written(made, "filter")), "_map")
    passes = F.lit(True)
    for bit in _bits(key):
        passes = passes & present(bit)
    return met.filter(passes).select(rows.columns)
