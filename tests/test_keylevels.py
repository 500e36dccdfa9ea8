"""Seen keys in levels: against a plain set, and for how little is read."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from pagemill.sources import keylevels as K

DAY = datetime.datetime(2024, 1, 1)


def _keys(spark, names):
    return spark.createDataFrame([("content" if len(n) % 2 else "url", n) for n in names], "key_type string, key string")


def _found(df):
    return sorted((r.key_type, r.key, r.run, r.batch_id) for r in df.collect())


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _files_read(spark, path, asked, run, before):
    """Files of keys and filters that a lookup opens."""
    found = K.stored_among(spark, path, asked, run, before)
    live = K.read_manifest(spark, path).segments
    return len(found.inputFiles()), len(live)


def test_fifty_batches(spark, tmp_path, few_partitions):
    """Every batch finds what earlier ones stored, and reads a bounded number of files."""
    rng = random.Random(4)
    path, stored, most = str(tmp_path / "keys"), {}, 0
    for batch in range(50):
        K.settle(spark, path, "r", batch, fan_in=3)
        live = K.read_manifest(spark, path).segments
        most = max(most, len(live))
        assert all(sum(s.level == level for s in live) <= 3 for level in range(6))
        new = {f"key{rng.randrange(400)}{'x' * rng.randrange(2)}" for _ in range(8)} - set(stored)
        if batch % 7 == 0:
            asked = [*rng.sample(sorted(stored), min(len(stored), 5)), *new, f"never{batch}"]
            found = K.stored_among(spark, path, _keys(spark, asked), "r", batch)
            assert _found(found) == sorted((stored[n][0], n, "r", stored[n][1]) for n in asked if n in stored)
        K.append_keys(spark, path, _keys(spark, sorted(new)), F.lit(DAY), "r", batch)
        stored.update({n: ("content" if len(n) % 2 else "url", batch) for n in new})
    assert most <= 11  # 3 of each of 3 full levels, and those just merged; not 50
    assert sorted(r.key for r in K.read_keys(spark, path).collect()) == sorted(stored)
    assert {s.level for s in K.read_manifest(spark, path).segments} >= {1, 2}
    files, live = _files_read(spark, path, _keys(spark, ["never1", "never2"]), "r", 50)
    assert files <= 1 < live


def test_a_batch_that_runs_again_finds_its_own_segment(spark, tmp_path):
    path = str(tmp_path / "keys")
    for batch in range(4):
        K.append_keys(spark, path, _keys(spark, [f"k{batch}"]), F.lit(DAY), "r", batch)
    K.settle(spark, path, "r", 3, fan_in=2)
    assert sorted((s.level, s.keys) for s in K.read_manifest(spark, path).segments) == [(0, 1), (1, 3)]
    asked = _keys(spark, [f"k{b}" for b in range(4)])
    assert [r.key for r in K.stored_among(spark, path, asked, "r", 3).orderBy("key").collect()] == ["k0", "k1", "k2"]
    assert K.stored_among(spark, path, asked).count() == 4 == K.stored_among(spark, path, asked, "other", 0).count()
    # Merged batches are told apart by their rows: another run's view does not depend on merges.
    K.settle(spark, path, "other", 0, fan_in=2)
    assert [r.key for r in K.stored_among(spark, path, asked, "r", 2).orderBy("key").collect()] == ["k0", "k1"]
    K.append_keys(spark, path, _keys(spark, ["k3", "z"]), F.lit(DAY), "r", 3)
    assert K.stored_among(spark, path, _keys(spark, ["z"]), "r", 4).count() == 1


def test_filters_have_no_false_negatives_and_few_false_positives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "FILE_KEYS", 2000)
    path = str(tmp_path / "keys")
    rows = spark.range(20_000).select(F.lit("content").alias("key_type"), F.sha2(F.col("id").cast("string"), 256).alias("key"))
    K.append_keys(spark, path, rows, F.lit(DAY), "r", 0)
    segment, = K.read_manifest(spark, path).segments
    assert (segment.keys, segment.files) == (20_000, 10) and segment.blocks == 10
    assert K.candidates(spark, path, rows, [segment]).count() == 20_000
    others = spark.range(20_000, 60_000).select(F.lit("content").alias("key_type"), F.sha2(F.col("id").cast("string"), 256).alias("key"))
    assert K.candidates(spark, path, others, [segment]).count() < 400
    few = K.stored_among(spark, path, rows.limit(3))
    assert few.count() == 3 and len(few.inputFiles()) >= 1
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [file" in plan


def test_retention_and_empty_batches(spark, tmp_path):
    path = str(tmp_path / "keys")
    for batch in range(3):
        K.append_keys(spark, path, _keys(spark, [f"k{batch}"] if batch else []), F.lit(DAY + datetime.timedelta(days=batch)), "r", batch)
    assert K.stored_among(spark, path, _keys(spark, ["k1", "k2"])).count() == 2
    K.settle(spark, path, "r", 3, fan_in=2, kept=F.col("first_seen") >= F.lit(DAY + datetime.timedelta(days=2)))
    assert [r.key for r in K.read_keys(spark, path).collect()] == ["k2"]
    assert K.stored_among(spark, str(tmp_path / "none"), _keys(spark, ["k1"])).count() == 0


def test_merged_segments_are_removed_one_change_later(spark, tmp_path):
    path = str(tmp_path / "keys")
    for batch in range(2):
        K.append_keys(spark, path, _keys(spark, [f"k{batch}"]), F.lit(DAY), "r", batch)
    old = {s.name for s in K.read_manifest(spark, path).segments}
    K.settle(spark, path, "r", 2, fan_in=2)
    there = lambda: {p.name for p in (tmp_path / "keys" / "keys").iterdir()}
    assert old <= there()
    K.append_keys(spark, path, _keys(spark, ["k9"]), F.lit(DAY), "r", 2)
    assert not old & there() and K.read_keys(spark, path).count() == 3
