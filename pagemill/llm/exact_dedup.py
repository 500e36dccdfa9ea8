"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Each partition sorts short fingerprints of its texts and sends them, coded, to
the owners of their ranges.  An owner answers every sender with a bitmap of
the fingerprints that it has seen more than once.  Only the texts so marked
are shuffled, and their bytes decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm import golomb
from pagemill.llm.common import filtered, text_of
from pagemill.session import written

WHITE = r"[\x20\x09-\x0D]+"


def squeezed(text_col: str) -> Column:
    """The text without white space."""
    return F.regexp_replace(text_of(text_col), WHITE, "")


def exact_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", spare_bits: int = 8, owner_rows: int = 4_000_000, least_owners: int = 256,
) -> DataFrame:
    """A row for each row of ``df``: ``id_col``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when they agree in every byte after white space is taken
    out.  Of equal texts the row with the most code points in its own text
    stays, then the one with the smallest id (a null id counts as smallest);
    of rows that agree in these too, exactly one stays.

    A fingerprint has ``spare_bits`` more bits than the row count needs, so
    about one unique text in 2**``spare_bits`` is compared without need.
    """
    rows = written(
        df.select(F.col(id_col).alias("id"), F.unhex(F.sha2(squeezed(text_col), 256)).alias("sha"), F.length(text_of(text_col)).alias("points")),
        "dedup-rows",
    )
    count = max(1, rows.count())
    bits = min(60, max(16, math.ceil(math.log2(count)) + spare_bits))
    owner_bits = min(bits, math.ceil(math.log2(max(least_owners, count / owner_rows))))
    sent = written(rows.mapInArrow(_sender(bits, owner_bits), _sent_schema(rows)), "dedup-sent")
    answers = sent.filter("blob IS NOT NULL").select("src", "owner", "blob").groupBy("owner").applyInPandas(_answer, "src int, owner int, bitmap binary")
    return _decided(df, sent.filter("blob IS NULL").drop("blob"), answers, id_col, text_col)


def _sent_schema(rows: DataFrame) -> str:
    kind = rows.schema["id"].dataType.simpleString()
    return f"id {kind}, sha binary, points int, src int, owner int, pos int, row int, twice boolean, blob binary"


def _sender(bits: int, owner_bits: int):
    low = bits - owner_bits

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their places in what is sent, then a coded message to each owner."""
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        held = pa.Table.from_batches(table).combine_chunks()
        src, n = TaskContext.get().partitionId(), held.num_rows
        heads = np.frombuffer(b"".join(x[:8] for x in held["sha"].to_pylist()), ">u8")
        prints, at, times = np.unique(heads >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
        owners = (prints >> np.uint64(low)).astype(np.int32)
        first = np.searchsorted(owners, np.arange((1 << owner_bits) + 1))
        place = (np.arange(len(prints)) - first[owners]).astype(np.int32)
        found = {
            "src": pa.array(np.full(n, src, np.int32)), "owner": pa.array(owners[at]), "pos": pa.array(place[at]),
            "row": pa.array(np.arange(n, dtype=np.int32)), "twice": pa.array(times[at] > 1), "blob": pa.nulls(n, pa.binary()),
        }
        for name, column in found.items():
            held = held.append_column(name, column)
        schema = held.schema
        yield from held.to_batches(max_chunksize=10_000)
        to = [o for o in range(1 << owner_bits) if first[o] < first[o + 1]]
        inside = prints & np.uint64((1 << low) - 1)
        blobs = [golomb.encode(inside[first[o]:first[o + 1]], 1 << low) for o in to]
        made = {"src": pa.array([src] * len(to), pa.int32()), "owner": pa.array(to, pa.int32()), "blob": pa.array(blobs, pa.binary())}
        yield pa.RecordBatch.from_arrays([made.get(f.name, pa.nulls(len(to), f.type)) for f in schema], schema=schema)

    return send


def _answer(messages: pd.DataFrame) -> pd.DataFrame:
    """For each message a bitmap: which of its fingerprints came more than once."""
    parts = [golomb.decode(b) for b in messages.blob]
    _, at, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    seen = np.split(times[at] > 1, np.cumsum([len(p) for p in parts])[:-1])
    return pd.DataFrame({"src": messages.src, "owner": messages.owner, "bitmap": [np.packbits(s).tobytes() for s in seen]})


def _decided(df: DataFrame, rows: DataFrame, answers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    octet = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = (
        answers.select("src", "owner", "bitmap", F.explode(F.sequence(F.lit(0), F.octet_length("bitmap") * 8 - 1)).alias("bit"))
        .filter(F.getbit(octet, (7 - F.pmod("bit", F.lit(8))).cast("int")) == 1)
        .select("src", "owner", F.col("bit").alias("pos"), F.lit(True).alias("elsewhere"))
    )
    rows = written(
        rows.join(marked, ["src", "owner", "pos"], "left").select("id", "sha", "points", "src", "row", (F.col("twice") | F.coalesce("elsewhere", F.lit(False))).alias("suspect")),
        "dedup-marked",
    )
    suspects = rows.filter("suspect")
    # A filter of bounded size lets the suspects' texts through, and few others, before anything is shuffled.
    texts = df.select(squeezed(text_col).alias("squeezed")).withColumn("sha", F.unhex(F.sha2("squeezed", 256)))
    same = filtered(texts, suspects.select("sha").distinct(), "sha").groupBy("sha", "squeezed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    clash = F.raise_error(F.lit("two texts with one SHA-256"))
    sure = same.groupBy("sha").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n")).select("sha", F.when(F.col("texts") > 1, clash).otherwise(F.col("n")).cast("long").alias("group_size"))
    order = F.struct((-F.col("points")).alias("p"), "id", "src", "row")
    best = suspects.groupBy("sha").agg(F.min(order).alias("best"))
    # Written, so that the join below has plain exchanges on both sides and a hot group's rows can be split over tasks.
    groups = written(sure.join(best, "sha"), "dedup-groups")
    return rows.join(groups, "sha", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("best").isNull() | (F.col("best") == order)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
