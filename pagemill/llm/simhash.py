"""Near-duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint has two segments of 32 bits.  If two fingerprints differ in at
most three bits, one of their segments differs in at most one.  So each
segment's value is entered once in that segment's table, every value within
one bit of it is looked up there, and what is found is compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import slices, takes_over, text_of
from pagemill.llm.components import components
from pagemill.session import written

_SHINGLES = 1 << 16


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a text in UTF-8, as a signed 64-bit number; zero without words.

    A bit is one if it is set in over half of the shingles' XXH64, repeats
    included.  A-Z count as a-z; words are divided by ASCII white space.
    """
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = ends - np.diff(ends, prepend=0)
    if len(parts) <= words:
        first, last = [0], [len(joined)]
    else:
        first, last = starts[: len(parts) - words + 1].tolist(), (ends[words - 1:] - 1).tolist()
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(first)
    for k in range(0, n, _SHINGLES):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(first[k:k + _SHINGLES], last[k:k + _SHINGLES])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """``id`` and ``print`` (signed 64-bit) for each row."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_over("simhash")
        for batch in slices(batches):
            made = [fingerprint(t.encode(), words, seed) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.int64())], ["id", "print"])

    source = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return source.mapInArrow(prints, f"id {source.schema['id'].dataType.simpleString()}, print long")


def near_links(distinct: DataFrame, distance: int = 3, hot_rows: int = 2048) -> DataFrame:
    """``(a, b)`` fingerprints whose links connect all that differ in at most ``distance`` (up to 3) bits.

    ``distinct`` has one column ``print``.  A pair is given by each table that
    finds it.  A table's value that ``hot_rows`` or more fingerprints share is
    compared in tiles, from which come links enough to connect whatever the
    tile's pairs would connect, so that a large group of near-copies does not
    turn into all of its pairs.
    """
    segment = F.explode(F.array(F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned("print", 32).alias("key")),
                                F.struct(F.lit(1).alias("seg"), F.col("print").bitwiseAND((1 << 32) - 1).alias("key"))))
    index = distinct.select("print", segment.alias("s")).select("s.seg", "s.key", "print")
    flips = F.explode(F.array(F.lit(0).cast("long"), *(F.lit(1 << k).cast("long") for k in range(32))))
    probes = index.select("seg", "key", "print", flips.alias("flip")).select("seg", F.col("key").bitwiseXOR(F.col("flip")).alias("key"), F.col("print").alias("other"), "flip")
    counted = written(index.groupBy("seg", "key").count().filter(F.col("count") >= hot_rows), "simhash-hot")
    if counted.isEmpty():
        return _matched(index, probes, distance)
    tiles = _tiled(index, probes, counted.withColumn("tiles", F.ceil(F.col("count") / hot_rows).cast("int")), distance)
    keys = counted.select("seg", "key")
    cool = _matched(index.join(keys, ["seg", "key"], "left_anti"), probes.join(keys, ["seg", "key"], "left_anti"), distance)
    return cool.unionAll(tiles)


def _matched(index: DataFrame, probes: DataFrame, distance: int) -> DataFrame:
    near = (F.bit_count(F.col("print").bitwiseXOR(F.col("other"))) <= distance) & ((F.col("flip") != 0) | (F.col("print") < F.col("other")))
    there = index.withColumnsRenamed({"seg": "_seg", "key": "_key"})
    # Merged, never broadcast: Spark's guess of a side's size does not see that its rows were multiplied.
    met = there.hint("merge").join(probes.hint("merge"), (F.col("_seg") == F.col("seg")) & (F.col("_key") == F.col("key")) & near)
    return met.select(F.least("print", "other").alias("a"), F.greatest("print", "other").alias("b"))


def _tiled(index: DataFrame, probes: DataFrame, hot: DataFrame, distance: int) -> DataFrame:
    """Compare each block of a hot value's entries with each block of what looks it up."""
    block = lambda name: F.pmod(F.xxhash64(name), F.col("tiles")).cast("int")
    entered = index.join(hot, ["seg", "key"]).select("seg", "key", block("print").alias("i"), F.explode(F.sequence(F.lit(0), F.col("tiles") * 33 - 1)).alias("j"), "print", F.lit(True).alias("entry"))
    asked_block = block("other") * 33 + F.pmod(F.xxhash64("flip"), F.lit(33)).cast("int")
    asked = probes.join(hot, ["seg", "key"]).select("seg", "key", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("i"), asked_block.alias("j"), F.col("other").alias("print"), F.lit(False).alias("entry"))

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        left, right = tile.print[tile.entry].to_numpy(), tile.print[~tile.entry].to_numpy()
        return pd.DataFrame(spanning(left, right, distance), columns=["a", "b"], dtype="int64")

    return entered.unionAll(asked).groupBy("seg", "key", "i", "j").applyInPandas(compare, "a long, b long")


def spanning(left: np.ndarray, right: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what the near pairs of ``left`` x ``right`` connect: at most one for each number."""
    nodes = np.unique(np.concatenate([left, right]))
    is_left, is_right = np.isin(nodes, left), np.isin(nodes, right)
    new, links = np.ones(len(nodes), bool), []
    for start in range(len(nodes)):
        if not new[start]:
            continue
        new[start], queue = False, [start]
        while queue:
            at = queue.pop()
            near = np.bitwise_count((nodes ^ nodes[at]).view(np.uint64)) <= distance
            near &= new & ((is_left[at] & is_right) | (is_right[at] & is_left))
            found = np.flatnonzero(near)
            new[found] = False
            queue += found.tolist()
            links += [(int(nodes[at]), int(nodes[f])) for f in found]
    return links


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, distance: int = 3) -> DataFrame:
    """A row for each row of ``df``: ``id_col``, ``fingerprint`` (16 lowercase hex digits) and ``component_id``.

    ``component_id`` is the smallest id that links reach, itself included; a
    null id is not counted, and where there are only null ids it is null.
    Texts without words have the fingerprint zero and link like others.
    """
    prints = written(fingerprints(df, id_col, text_col, words, seed), "simhash-prints")
    classes = prints.groupBy("print").agg(F.min("id").alias("least"))
    roots = components(near_links(classes.select("print"), distance)).withColumnRenamed("node", "print")
    rooted = classes.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(named, "root").select("print", "component_id")
    return prints.join(by_print, "print").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
