"""The table of seen keys, in levels, so that a batch reads little of it.

Every batch adds a segment: its keys in files by ranges of a hash, and a
Bloom filter of them.  When a level holds ``fan_in`` segments they become one
of the next level, so after n batches there are about fan_in * log(n) of them.
A lookup tests the asked keys against the filters, a few bits a key, and reads
only the files that may hold one of them; the rows decide, not the filters.

A small manifest names the segments that count.  It is replaced as a whole, so
a writer that fails leaves the table as it was.  One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from pagemill.schemas import SEEN_KEYS
from pagemill.session import written

FAN_IN = 8
# Keys in a file, and bits for each in a Bloom filter of which so many are set.
FILE_KEYS = 1_000_000
KEY_BITS, HASHES = 16, 5
_BLOCK_BITS = 32768  # the size of Spark's bitmaps
_BLOCKS_PER_FILE = 16384

KEY_ROWS = StructType([*SEEN_KEYS.fields, StructField("run", StringType()), StructField("batch_id", LongType())])
_FILES = StructType([*KEY_ROWS.fields, StructField("file", IntegerType())])
_KEY = ["key_type", "key"]


@dataclass(frozen=True)
class Segment:
    """``files`` and ``blocks`` are the numbers of hash ranges of its keys and its filter."""

    name: str
    level: int
    keys: int
    files: int
    blocks: int
    run: str | None
    batch_id: int | None


@dataclass(frozen=True)
class Manifest:
    version: int
    segments: tuple[Segment, ...]
    retired: tuple[str, ...]  # replaced by the last change; their files go with the next


# --- the manifest ----------------------------------------------------------


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    place, files = _folder(spark, f"{path}/manifest")
    names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    versions = _versions(spark, path)
    if not versions:
        return Manifest(0, (), ())
    place, files = _folder(spark, f"{path}/manifest/{versions[-1]}.json")
    stream = files.open(place)
    try:
        held = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Manifest(versions[-1], tuple(Segment(**s) for s in held["segments"]), tuple(held["retired"]))


def _replace(spark: SparkSession, path: str, old: Manifest, segments: Sequence[Segment]) -> Manifest:
    """Write the next manifest.  Segments it leaves out are removed by the change after it, when no one reads them any more."""
    names = {s.name for s in segments}
    new = Manifest(old.version + 1, tuple(segments), tuple(s.name for s in old.segments if s.name not in names))
    text = json.dumps({"segments": [asdict(s) for s in new.segments], "retired": new.retired})
    place, files = _folder(spark, f"{path}/manifest/_{new.version}-{uuid.uuid4().hex}")
    stream = files.create(place, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    target, _ = _folder(spark, f"{path}/manifest/{new.version}.json")
    if not files.rename(place, target):
        raise RuntimeError(f"another writer has changed {path}")
    for name in old.retired:
        if name not in names:
            for kind in ("keys", "filters"):
                files.delete(_folder(spark, f"{path}/{kind}/{name}")[0], True)
    for version in _versions(spark, path)[:-3]:
        files.delete(_folder(spark, f"{path}/manifest/{version}.json")[0], False)
    return new


# --- segments --------------------------------------------------------------


def _hash() -> Column:
    return F.xxhash64(*_KEY)


def _place(h: Column, count: Column | int) -> Column:
    return F.pmod(h, F.lit(count) if isinstance(count, int) else count).cast("int")


def _bits() -> Column:
    """The bits of a key in its block."""
    return F.array(*(F.pmod(F.xxhash64(F.lit(i), *_KEY), F.lit(_BLOCK_BITS)).cast("int") for i in range(HASHES)))


def _write_segment(rows: DataFrame, path: str, name: str, level: int, run: str | None, batch_id: int | None) -> Segment:
    """Write the keys of a segment and its filter; ``rows`` is read three times."""
    count = rows.count()
    files, blocks = -(-count // FILE_KEYS) or 1, -(-count * KEY_BITS // _BLOCK_BITS) or 1
    placed = rows.select(*KEY_ROWS.names, _place(_hash(), files).alias("file"))
    placed.repartition(files, "file").sortWithinPartitions("file", *_KEY).write.mode("overwrite").partitionBy("file").parquet(f"{path}/keys/{name}")
    bits = rows.select(_place(_hash(), blocks).alias("block"), F.explode(_bits()).alias("bit"))
    filters = bits.groupBy("block").agg(F.bitmap_construct_agg(F.col("bit").cast("bigint")).alias("bits"))
    filters.select(F.lit(name).alias("segment"), "block", "bits").coalesce(-(-blocks // _BLOCKS_PER_FILE)).write.mode("overwrite").parquet(f"{path}/filters/{name}")
    return Segment(name, level, count, files, blocks, run, batch_id)


def append_keys(spark: SparkSession, path: str, keys: DataFrame, first_seen: Column, run: str, batch_id: int) -> None:
    """Add the keys (``key_type, key``, written or cheap to compute) of a batch.  The same batch again replaces what it added."""
    name = f"{run}-{batch_id:012d}"
    rows = keys.select(*_KEY, first_seen.alias("first_seen"), F.lit(run).alias("run"), F.lit(batch_id).cast("bigint").alias("batch_id"))
    segment = _write_segment(rows, path, name, 0, run, batch_id)
    now = read_manifest(spark, path)
    _replace(spark, path, now, [*(s for s in now.segments if s.name != name), segment])


def _keys_in(spark: SparkSession, path: str, segment: Segment) -> DataFrame:
    return spark.read.schema(_FILES).parquet(f"{path}/keys/{segment.name}")


def _union(tables: list[DataFrame], spark: SparkSession) -> DataFrame:
    if not tables:
        return spark.createDataFrame([], KEY_ROWS)
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """All key rows of the table."""
    return _union([_keys_in(spark, path, s).select(*KEY_ROWS.names) for s in read_manifest(spark, path).segments], spark)


def settle(spark: SparkSession, path: str, run: str | None = None, before: int | None = None, fan_in: int = FAN_IN, kept: Column | None = None) -> None:
    """Merge the segments of every level that holds ``fan_in`` or more.

    A batch that may still run again must find its own segment as it was: of
    ``run``, only batches before ``before`` are merged.  Rows that do not meet
    ``kept`` (retention) are left behind.
    """
    now, level = read_manifest(spark, path), 0
    while any(s.level >= level for s in now.segments):
        own = [s for s in now.segments if s.level == level and (s.run != run or s.batch_id is None or before is None or s.batch_id < before)]
        if len(own) >= fan_in:
            rows = _union([_keys_in(spark, path, s).select(*KEY_ROWS.names) for s in own], spark)
            merged = _write_segment(rows if kept is None else rows.filter(kept), path, f"level{level + 1}-{uuid.uuid4().hex}", level + 1, None, None)
            now = _replace(spark, path, now, [s for s in now.segments if s not in own] + [merged])
        level += 1


# --- lookup ----------------------------------------------------------------


def _has(bits: Column, bit: Column) -> Column:
    """Is a bit of a bitmap set?  Byte by byte, the lowest bit of a byte first."""
    byte = F.conv(F.hex(F.substr(bits, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, bit % 8) == 1


def candidates(spark: SparkSession, path: str, asked: DataFrame, segments: Sequence[Segment]) -> DataFrame:
    """``segment, file, key_type, key``: where an asked key may lie."""
    places = F.array(*(F.struct(F.lit(s.name).alias("segment"), F.lit(s.files).alias("files"), F.lit(s.blocks).alias("blocks")) for s in segments))
    each = asked.select(*_KEY, _hash().alias("h"), F.explode(places).alias("s")).select(
        *_KEY, "s.segment", _place(F.col("h"), F.col("s.files")).alias("file"), _place(F.col("h"), F.col("s.blocks")).alias("block"), _bits().alias("set"),
    )
    filters = spark.read.schema("segment string, block int, bits binary").parquet(*(f"{path}/filters/{s.name}" for s in segments))
    every = _has(F.col("bits"), F.get("set", F.lit(0)))
    for i in range(1, HASHES):
        every = every & _has(F.col("bits"), F.get("set", F.lit(i)))
    return each.join(filters, ["segment", "block"]).filter(every).select("segment", "file", *_KEY)


def stored_among(spark: SparkSession, path: str, asked: DataFrame, run: str | None = None, before: int | None = None) -> DataFrame:
    """Stored rows whose key is among ``asked`` (distinct ``key_type, key``).

    With ``run``, its batches from ``before`` on are not there: a batch that
    runs again does not meet its own keys, and earlier ones only.
    """
    live = [s for s in read_manifest(spark, path).segments if s.keys and not (run is not None and s.run == run and s.batch_id >= before)]
    if not live:
        return spark.createDataFrame([], KEY_ROWS)
    maybe = written(candidates(spark, path, asked, live), "key-candidates")
    # One row for each file that may hold a key: as many as there are files, at most.
    places: dict[str, list[int]] = {}
    for row in maybe.select("segment", "file").distinct().collect():
        places.setdefault(row["segment"], []).append(row["file"])
    rows = [_keys_in(spark, path, s).filter(F.col("file").isin(places[s.name])).select(*KEY_ROWS.names) for s in live if s.name in places]
    found = _union(rows, spark).join(maybe.select(*_KEY).distinct(), _KEY, "left_semi")
    return found if run is None else found.filter((F.col("run") != run) | (F.col("batch_id") < before))
