"""Connected components by star contraction, for link tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has a link; ``root`` is the smallest node that links reach.

    Large-star and small-star steps in turn, until nothing changes.  A step
    needs one aggregate with map-side combine and one join, so a node with
    very many links does not have to fit in a task.  Links to itself and
    repeated links do no harm.
    """
    pairs = links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).filter("high > low").distinct()
    before = None
    while True:
        pairs = cut_lineage(_small_star(_large_star(pairs)))
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if now == before:
            return pairs.select(F.col("high").alias("node"), F.col("low").alias("root"))
        before = now


def _large_star(pairs: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = pairs.select(F.col("high").alias("node"), F.col("low").alias("other")).unionAll(
        pairs.select(F.col("low").alias("node"), F.col("high").alias("other"))
    )
    least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
    larger = pairs.select(F.col("low").alias("node"), F.col("high").alias("other"))
    return larger.join(least, "node").select(F.col("other").alias("high"), F.col("m").alias("low"))


def _small_star(pairs: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest of them."""
    least = pairs.groupBy("high").agg(F.min("low").alias("m"))
    moved = pairs.join(least, "high").select(F.col("low").alias("high"), F.col("m").alias("low")).filter("high > low")
    return moved.unionAll(least.select("high", F.col("m").alias("low"))).distinct()
