"""Duplicate detection by URL, content, title and near-duplicate keys.

All joins and groupings run on narrow key rows; page text is read once, to
compute the keys.  Keys shared by very many rows are combined before any
shuffle or spread over tasks, so one popular text cannot stall a job.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import content_hash, fuzzy_hash, normalized, title_hash
from pagemill.functions.urls import url_key_hash
from pagemill.functions.values import HASH_RETENTION_DAYS
from pagemill.operators.skew import HOT_ROWS, exploded, hot_keys, salted_join
from pagemill.session import built_once, written

KEY_TYPES = ("url", "content", "title", "fuzzy")
STRICT = ("url", "content")
DEFAULT = ("url", "content", "fuzzy")  # an equal title never decides


# The normalised content, for which both its keys would else read the text.
_NORMAL = "_normal_content"


@built_once
def _key_columns(present: frozenset):
    def column(name: str) -> Column:
        return F.col(name) if name in present else F.lit(None).cast("string")

    url, title, content, normal = column("url"), column("title"), column("content"), F.col(_NORMAL)
    return normalized(content).alias(_NORMAL), (
        url_key_hash(url).alias("url_key"),
        content_hash(content, normal).alias("content_key"),
        title_hash(title).alias("title_key"),
        fuzzy_hash(content, F.coalesce(title, F.lit("")), normal).alias("fuzzy_key"),
    )


def with_keys(records: DataFrame) -> DataFrame:
    """Adds ``url_key, content_key, title_key, fuzzy_key``; null where there is nothing to compare.

    Missing ``url``, ``title`` or ``content`` columns count as null.
    """
    present = frozenset(c for c in ("url", "title", "content") if c in records.columns)
    normal, keys = _key_columns(present)
    return records.select("*", normal).select("*", *keys).drop(_NORMAL)


def key_rows(keyed: DataFrame, types: Sequence[str] = KEY_TYPES, carry: Sequence[str] = ("id",)) -> DataFrame:
    """Long form: one row ``(*carry, key_type, key)`` per key that is not null."""
    pairs = F.array(*[F.struct(F.lit(t).alias("key_type"), F.col(f"{t}_key").alias("key")) for t in types])
    present = F.filter(pairs, lambda p: p["key"].isNotNull())
    return exploded(keyed, present, "k", *carry).select(*carry, "k.key_type", "k.key")


def duplicate_flags(keyed: DataFrame, seen: DataFrame, id: str = "id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Four flags per row: is its key of that type among the ``seen`` keys (``key_type, key``)?

    ``keyed`` is read three times: hand in a table or something materialised.
    """
    rows = key_rows(keyed, carry=(id,))
    hits = salted_join(
        rows, seen.select("key_type", "key"), ["key_type", "key"], "left_semi", [id], hot_rows
    )
    flags = hits.groupBy(id).agg(
        *[F.max(F.col("key_type") == t).alias(f"{t}_duplicate") for t in KEY_TYPES]
    )
    joined = keyed.join(flags, id, "left")
    return joined.select(
        *keyed.columns,
        *[F.coalesce(f"{t}_duplicate", F.lit(False)).alias(f"{t}_duplicate") for t in KEY_TYPES],
    )


def is_duplicate(strict: bool = False) -> Column:
    """Verdict from the four flags."""
    types = STRICT if strict else DEFAULT
    return reduce(lambda a, b: a | b, [F.col(f"{t}_duplicate") for t in types])


def keep_first(df: DataFrame, key: str, order: str, id: str = "id") -> DataFrame:
    """The first row in ``order`` of every ``key``; rows without a key are all kept.

    One shuffle.  Spark trims every map task to one row per key before it
    (window group limit), so a key with a third of all rows stays harmless,
    and rows without a key are spread by their ``id``.
    """
    own = F.when(F.col(key).isNull(), F.col(id))
    first = Window.partitionBy(F.col(key), own).orderBy(order, id)
    return df.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def as_of_flags(keyed: DataFrame, kept: DataFrame, order: str, id: str = "id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Four flags per row: had an earlier row that was *kept* the same key when this one came?

    ``kept`` has the ids of the rows that were stored (:func:`keep_greedy`);
    only those register their keys, of all four kinds.  So a key counts from
    the first kept row on that has it.  Adds ``kept`` as well.  ``keyed`` is
    read several times: hand in a table of ids, order and keys.
    """
    marked = keyed.join(kept.select(id).withColumn("kept", F.lit(True)), id, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    rows = key_rows(marked.select(F.col(id).alias("_i"), F.col(order).alias("_o"), "kept", *(f"{t}_key" for t in KEY_TYPES)), carry=("_i", "_o", "kept"))
    registered = rows.filter("kept").groupBy("key_type", "key").agg(F.min(F.struct("_o", "_i")).alias("_from"))
    hits = salted_join(rows, registered, ["key_type", "key"], "inner", ["_i"], hot_rows).filter(F.struct("_o", "_i") > F.col("_from"))
    flags = hits.groupBy(F.col("_i").alias(id)).agg(*[F.max(F.col("key_type") == t).alias(f"{t}_duplicate") for t in KEY_TYPES])
    return marked.join(flags, id, "left").select(
        *keyed.columns, "kept", *[F.coalesce(f"{t}_duplicate", F.lit(False)).alias(f"{t}_duplicate") for t in KEY_TYPES],
    )


def duplicate_stats(flagged: DataFrame) -> DataFrame:
    """Checks, hits per type (titles counted too) and sizes of the sets of registered keys, from :func:`as_of_flags`.

    Every registered key has one kept row that is no duplicate by it, the one
    that registered it, so the sets need no distinct count.
    """

    def size(t: str) -> Column:
        return F.count_if(F.col("kept") & F.col(f"{t}_key").isNotNull() & ~F.col(f"{t}_duplicate"))

    return flagged.agg(
        F.count(F.lit(1)).alias("total_checks"),
        *[F.count_if(F.col(f"{t}_duplicate")).alias(f"{t}_duplicates") for t in KEY_TYPES],
        *[size(t).alias(f"total_{t}_hashes") for t in KEY_TYPES],
    )


def new_keys(stored: DataFrame, seen: DataFrame, first_seen: Column) -> DataFrame:
    """Key rows to append to the seen table for newly stored pages."""
    rows = key_rows(stored, carry=()).distinct()
    return rows.join(seen.select("key_type", "key"), ["key_type", "key"], "left_anti").withColumn(
        "first_seen", first_seen
    )


def retained_keys(seen: DataFrame, now: Column, days: int = HASH_RETENTION_DAYS) -> DataFrame:
    """Keys first seen within the retention time."""
    return seen.filter(F.col("first_seen") >= now - F.make_dt_interval(F.lit(days)))


# --- greedy keep-first over several keys -----------------------------------


def _keys_of(types: Sequence[str]) -> Column:
    return F.filter(F.array(*[F.col(f"{t}_key") for t in types]), lambda k: k.isNotNull())


def _winners(rows: DataFrame, *others: str) -> DataFrame:
    """Per key the first row and the number of rows."""
    return rows.groupBy("key_type", "key").agg(F.min(F.struct("_o", "_i", *others)).alias("w"), F.count(F.lit(1)).alias("n"))


def _with_count(rows: DataFrame, types: Sequence[str]) -> DataFrame:
    return rows.withColumn("_keys", F.size(_keys_of(types)))


def keep_greedy(
    keyed: DataFrame,
    order: str,
    types: Sequence[str] = DEFAULT,
    id: str = "id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Ids of the rows kept when pages arrive in ``order`` and only kept pages register their keys.

    A row is dropped only if an earlier *kept* row shares one of its keys, so
    this is neither keep-first per key nor connected components.  Steps:

    1. A key that occurs once can never conflict and is forgotten; a row left
       without keys is kept.
    2. Of rows with exactly the same remaining keys only the first can be
       kept (if it falls, its keys belong to an earlier kept row, and so the
       others fall too), so each such class shrinks to its first row.  This
       takes exact copies out, however many there are.
    3. Rounds over what is left: a row that is first in all its keys is kept;
       rows that share a key with a kept row are dropped.  Each round settles
       at least the earliest open row; the loop runs until none is open.

    A round writes one narrow table, the rows that were open with what became
    of them.  A kept row is the first of each of its keys, so the first rows
    of the keys tell which rows are kept and which keys are taken.
    """
    key_columns = [f"{t}_key" for t in types]
    narrow = keyed.select(F.col(id).alias("_i"), F.col(order).alias("_o"), *key_columns)
    single = (
        _winners(key_rows(narrow, types, carry=("_i", "_o"))).filter(F.col("n") == 1)
        .groupBy(F.col("w._i").alias("_i")).agg(F.collect_set("key_type").alias("_single"))
    )
    shared = written(
        narrow.join(single, "_i", "left").select(
            "_i", "_o",
            *[
                F.when(~F.coalesce(F.array_contains("_single", t), F.lit(False)), F.col(f"{t}_key")).alias(f"{t}_key")
                for t in types
            ],
        ),
        "greedy-keys",
    )
    has_keys = F.size(_keys_of(types)) > 0
    kept = shared.filter(~has_keys).select("_i")
    open_rows = written(
        _with_count(
            shared.filter(has_keys).groupBy(*key_columns).agg(F.min(F.struct("_o", "_i")).alias("f")).select("f._i", "f._o", *key_columns), types
        ),
        "greedy-round",
    )
    if open_rows.isEmpty():
        return kept.withColumnRenamed("_i", id)
    # The rows of a key only get fewer, so the hot keys of the first round are enough.
    hot = hot_keys(key_rows(open_rows, types, carry=()), ["key_type", "key"], hot_rows)
    while not open_rows.isEmpty():
        firsts = _winners(key_rows(open_rows, types, carry=("_i", "_o", "_keys")), "_keys")
        now_kept = firsts.groupBy(F.col("w._i").alias("_i"), F.col("w._keys").alias("_keys")).count().filter("count = _keys").select("_i")
        taken = firsts.select("key_type", "key", F.col("w._i").alias("_i")).join(now_kept, "_i", "left_semi").select("key_type", "key")
        touched = salted_join(
            key_rows(open_rows, types, carry=("_i",)), taken, ["key_type", "key"], "left_semi", ["_i"], hot=hot
        ).select("_i").distinct()
        became = open_rows.join(touched.withColumn("_touched", F.lit(True)), "_i", "left").join(now_kept.withColumn("_kept", F.lit(True)), "_i", "left")
        settled = written(became, "greedy-round")
        kept = kept.union(settled.filter("_kept").select("_i"))
        open_rows = settled.filter("_touched IS NULL").drop("_touched", "_kept")
    return kept.withColumnRenamed("_i", id)


def greedy_dedup(
    keyed: DataFrame,
    order: str,
    types: Sequence[str] = DEFAULT,
    id: str = "id",
    seen: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Adds ``kept``.  Rows whose key is among ``seen`` fall first and register nothing.

    Rows are marked by a last join with ``keyed``; where they carry text,
    hand in ids, order and keys alone and join the text to what is kept.
    """
    candidates = keyed
    if seen is not None:
        hits = salted_join(
            key_rows(keyed, types, carry=(id,)), seen.select("key_type", "key"),
            ["key_type", "key"], "left_semi", [id], hot_rows,
        ).select(id).distinct()
        candidates = keyed.join(hits, id, "left_anti")
    kept = keep_greedy(candidates, order, types, id, hot_rows).withColumn("kept", F.lit(True))
    return keyed.join(kept, id, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
