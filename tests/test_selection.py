"""Ranks and limits against a plain sort."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import frontier, metrics, selection


@pytest.mark.parametrize("small", [20, 300, 100_000])
def test_values_at_ranks(spark, small):
    rng = random.Random(small)
    groups = {"flat": [float(i) for i in range(3000)], "ties": [float(rng.randrange(5)) for _ in range(900)], "one": [1.5], "tail": [rng.expovariate(1) ** 8 for _ in range(2000)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("ties", None)], "g string, v double")
    quantiles = [0.0, 0.001, 0.25, 0.5, 0.999, 1.0]
    got = {(r.g, r.quantile): r.value for r in metrics.percentiles(df, "v", ["g"], quantiles, small).collect()}
    assert got == {(g, q): sorted(vs)[max(math.ceil(q * len(vs)), 1) - 1] for g, vs in groups.items() for q in quantiles}


def test_an_outlier_leaves_no_large_cell(spark, monkeypatch):
    """100,000 values below 0.5 and one of 30 days: the values around a rank get few at once."""
    sizes = []
    monkeypatch.setattr(selection, "_largest", lambda rows, by, original=selection._largest: sizes.append(original(rows, by)) or sizes[-1])
    values = spark.range(100_000).select(F.when(F.col("id") == 77, 2_592_000.0).otherwise(F.rand(3) / 2).alias("v"))
    values.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/outlier")
    values = spark.read.parquet(path)
    got = {r.quantile: r.value for r in metrics.percentiles(values, "v", [], [0.5, 0.9, 1.0], small=500).collect()}
    every = sorted(r.v for r in values.collect())
    assert got == {q: every[math.ceil(q * 100_000) - 1] for q in (0.5, 0.9, 1.0)}
    assert sizes[0] > 99_000 and sizes[1] < 100_000 / 40 and sizes[-1] <= 500 and len(sizes) <= 4


@pytest.mark.parametrize("n", [0, 1, 7, 40, 199, 200, 1000])
def test_first_rows(spark, n):
    rng = random.Random(n)
    rows = [(rng.randrange(6) / 2, rng.randrange(3), i) for i in rng.sample(range(10_000), 200)]
    df = spark.createDataFrame(rows, "a double, b int, c long")
    got = selection.first_rows(df, [F.col("a"), -F.col("b"), F.col("c")], n, small=30)
    assert sorted(map(tuple, got.collect())) == sorted(sorted(rows, key=lambda r: (r[0], -r[1], r[2]))[:n])


def test_limits_gather_nothing(spark):
    queue = spark.range(500).select(
        F.concat(F.lit("http://d"), F.col("id") % 7, F.lit("/"), "id").alias("url"), F.concat(F.lit("d"), F.col("id") % 7).alias("domain"),
        (F.col("id") % 4).cast("int").alias("priority"), "id",
    ).withColumnRenamed("id", "seq")
    none = spark.createDataFrame([], "domain string, ts timestamp")
    plan = frontier.plan_batch(queue, none)
    limited = frontier.within_limits(plan, max_pages=120)
    text = limited._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in text and "Limit" not in text
    expected = sorted((r.not_before, -r.priority, r.seq) for r in plan.collect())[:120]
    assert sorted((r.not_before, -r.priority, r.seq) for r in limited.collect()) == expected
    assert sorted(r.seq for r in frontier.plan_batch(queue, none, max_pages=120).collect()) == sorted(r[2] for r in expected)
