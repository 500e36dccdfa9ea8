"""The value at a rank, and the first n rows, without a sort of all rows in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import written

# So many distinct values may be ranked together.
SMALL = 100_000
_CUTS = 64


def _counts(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Equal values cost one row from here on."""
    return values.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))


def _largest(rows: DataFrame, by: Sequence[str]) -> int:
    return rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def _inside(counts: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The values between the bounds of each target.  Targets are few; Spark broadcasts them where they are."""
    return counts.join(targets, list(keys)).filter((F.col("_lo").isNull() | (F.col("_v") >= F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") <= F.col("_hi"))))


def _narrowed(inside: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each target's bounds, narrowed to the one of some ``_CUTS`` cells that holds its rank.

    The cells are cut at sketched quantiles of the distinct values, so they
    are of like size whatever the values are; their counts are exact.
    """
    cuts = inside.groupBy(*by).agg(F.percentile_approx("_v", [i / _CUTS for i in range(1, _CUTS)], 20 * _CUTS).alias("_cuts"))
    cell = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    cells = inside.join(cuts, list(by)).groupBy(*by, cell.alias("_cell")).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_n"), F.first("_rank").alias("_rank")
    )
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        cells.withColumn("_before", before).filter((F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_n")))
        .select(*by, (F.col("_rank") - F.col("_before")).alias("_rank"), "_lo", "_hi")
    )


def values_at_ranks(values: DataFrame, value: str, keys: Sequence[str], wanted: Column, small: int = SMALL) -> DataFrame:
    """For each group the values at some ranks: ``keys, target, value, within, same``.

    ``wanted`` is an array of (``target``, ``rank``), which may use ``_total``,
    the number of values of the group; ranks count from 1 in ascending order.
    ``same`` values are equal to the one found, which is the ``within``-th of
    them.  Nulls do not count.  The values around each rank are narrowed down,
    round by round, until ``small`` distinct ones are left, and only those
    are ranked: rounds grow with the logarithm of the number of values.
    """
    keys, by = list(keys), [*keys, "target"]
    if not keys:
        found = values_at_ranks(values.withColumn("_all", F.lit(0)), value, ["_all"], wanted, small)
        return found.drop("_all")
    counts = _counts(values, keys, value)
    large = _largest(counts, keys) > small
    if large:
        counts = written(counts, "value-counts")
    targets = counts.groupBy(*keys).agg(F.sum("_n").alias("_total")).select(*keys, F.explode(wanted).alias("_w")).select(
        *keys, "_w.target", F.col("_w.rank").cast("bigint").alias("_rank"),
        F.lit(None).cast(counts.schema["_v"].dataType).alias("_lo"), F.lit(None).cast(counts.schema["_v"].dataType).alias("_hi"),
    )
    while large:
        targets = written(_narrowed(_inside(counts, targets, keys), by), "rank-bounds")
        large = _largest(_inside(counts, targets, keys), by) > small
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_v"))
    return (
        _inside(counts, targets, keys).withColumn("_upto", upto)
        .filter((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank")))
        .select(*by, F.col("_v").alias("value"), (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("within"), F.col("_n").alias("same"))
    )


def first_rows(df: DataFrame, order: Sequence[Column], n: int, small: int = SMALL) -> DataFrame:
    """The first ``n`` rows by ``order`` (ascending columns without nulls), unsorted; more only if rows agree in all of it.

    The n-th row's place in the order is found column by column; the rest is
    a filter, so no task holds n rows.  ``df`` is read several times.
    """
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(names, order)))
    if n <= 0:
        return df.limit(0)
    rest, left, taken, equal = keyed, n, F.lit(False), F.lit(True)
    for name in names:
        target = F.array(F.struct(F.lit(0).alias("target"), F.least(F.lit(left), F.col("_total")).alias("rank")))
        bound = values_at_ranks(rest, name, [], target, small).first()
        if bound is None:
            return df
        at = F.lit(bound["value"]).cast(keyed.schema[name].dataType)
        taken = taken | (equal & (F.col(name) < at))
        equal = equal & (F.col(name) == at)
        left = bound["within"]
        if bound["within"] == bound["same"]:
            break
        rest = rest.filter(F.col(name) == at)
    return keyed.filter(taken | equal).drop(*names)
