"""Helpers for keys that may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import written

HOT_ROWS = 1_000_000
# Tasks over which rows without a key are spread.
SALTS = 64


def exploded(df: DataFrame, array: Column, name: str, *keep: str | Column) -> DataFrame:
    """``keep`` and one row per array element; rows without elements go.

    A plain ``explode`` makes Spark infer a filter on the array, and computing
    the array once more for it would double the work of a costly one.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows, and ``salts``: into how many parts of ``hot_rows`` each is to be cut.

    Counted with map-side combine, and written, so that Spark knows its size:
    it broadcasts the list where that is small, and shuffles it where it is not.
    """
    parts = F.ceil(F.col("_n") / hot_rows).cast("bigint").alias("salts")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return written(counts.filter(F.col("_n") > hot_rows).select(*keys, parts), "hot-keys")


def salted_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str,
    spread_by: Sequence[str],
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join ``facts`` to ``lookup``; a hot fact key is cut into parts of about ``hot_rows`` rows.

    Only the lookup rows of hot keys are copied, once per part; all other rows
    join as usual.  Fact rows with a null key match nothing and are spread
    too.  ``how`` is inner, left, left_semi or left_anti.  ``facts`` is read
    twice, so hand in a scan or something materialised; or hand in ``hot``,
    from :func:`hot_keys` of these facts or of more.
    """
    hot = (hot_keys(facts, on, hot_rows) if hot is None else hot).withColumnRenamed("salts", "_salts")
    no_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    parts = F.when(no_key, F.lit(SALTS).cast("bigint")).otherwise(F.coalesce("_salts", F.lit(1).cast("bigint")))
    left = facts.join(hot, list(on), "left").withColumn("_salt", F.pmod(F.xxhash64(*spread_by), parts)).drop("_salts")
    copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_salts", F.lit(1).cast("bigint")) - 1)
    right = lookup.join(hot, list(on), "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def top_k_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, spread_by: Sequence[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The first ``k`` rows of every group, with ``rank`` from 1.

    Where the largest group has more than ``hot_rows`` rows, groups are first
    cut into parts of that size, and the best of each part go on, in as many
    rounds as it takes for a group to fit.  Spark's window group limit trims
    each map task before every shuffle.
    """
    parts = _parts_per_round(df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0, k, hot_rows)
    rows = df
    for number, salts in enumerate(parts):
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(F.lit(number), *spread_by), F.lit(salts)))
        within = Window.partitionBy(*keys, "_salt").orderBy(*order)
        rows = salted.withColumn("_first", F.row_number().over(within)).filter(F.col("_first") <= k).drop("_first", "_salt")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def _parts_per_round(largest: int, k: int, hot_rows: int) -> list[int]:
    """Into how many parts the largest group is cut, round by round."""
    rounds, most = [], max(hot_rows, 2 * k)
    while largest > most:
        rounds.append(-(-largest // most))
        largest = rounds[-1] * k
    return rounds


def rank_in_group(
    df: DataFrame,
    keys: Sequence[str],
    leading: Sequence[Column],
    seq: str,
    cell_bits: int = 18,
    group_facts: DataFrame | None = None,
) -> DataFrame:
    """``rank`` (from 1) of every row of its group, ordered by ``leading`` then ``seq``.

    ``seq`` is a unique integer, so one (group, leading, seq >> cell_bits) cell
    holds at most 2**cell_bits rows.  Rows are ranked inside their cell; the rows
    of earlier cells come from per-cell counts.  No group meets in one task,
    however large it is.  ``group_facts`` (one row per group) is joined to the
    cell counts, so its columns reach every row without a join by group.
    """
    names = [f"_l{i}" for i in range(len(leading))]
    cells = df.withColumn("_cell", F.shiftright(F.col(seq).cast("bigint"), cell_bits))
    for name, column in zip(names, leading):
        cells = cells.withColumn(name, column)
    cell_keys = [*keys, *names, "_cell"]
    before = Window.partitionBy(*keys).orderBy(*names, "_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cells.groupBy(*cell_keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    if group_facts is not None:
        offsets = offsets.join(group_facts, list(keys), "left")
    inside = F.row_number().over(Window.partitionBy(*cell_keys).orderBy(seq))
    return (
        cells.withColumn("_inside", inside)
        .join(offsets, cell_keys)
        .withColumn("rank", (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop(*names, "_cell", "_inside", "_before")
    )
